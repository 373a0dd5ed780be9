"""Numbered commits of a table: a pointer file for each, put in place by a rename that fails where another writer was first."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


class StaleBase(RuntimeError):
    """Another writer has committed this number."""


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, body) of the newest commit; (0, {}) without any."""
    numbers = committed(spark, path)
    return (numbers[-1], read(spark, path, numbers[-1])) if numbers else (0, {})


def committed(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/_pointers")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def read(spark: SparkSession, path: str, number: int) -> dict:
    fs, at = _fs(spark, f"{path}/_pointers/{number:010d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, number: int, body: dict) -> None:
    """Makes body commit number; raises StaleBase if that is taken. Readers see all of it or the one before.

    The file is written under a name of its own and moved: by a rename that doesn't overwrite, or on a local file system,
    whose renames do, by a link.
    """
    fs, target = _fs(spark, f"{path}/_pointers/{number:010d}.json")
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointers/{uuid.uuid4().hex}.part")
    out = fs.create(made, False)
    out.write(json.dumps(body).encode())
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(*(p.toUri().getPath() for p in (made, target)))
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(made, target, options)
    except Exception as e:
        if number in committed(spark, path):
            raise StaleBase(f"{path}: another writer has committed {number}") from e
        raise
    finally:
        fs.delete(made, False)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def new_name(number: int) -> str:
    """A folder that no other writer has."""
    return f"data/{number:010d}-{uuid.uuid4().hex}"
