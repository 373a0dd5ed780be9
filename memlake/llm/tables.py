"""Intermediate tables in the folder that the cluster shares, and joins that stand hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many keys of a join are hot, so that their table may be broadcast whatever the size of the data.
HOT_KEYS = 20_000
#: A key with fewer rows is never hot.
HOT_ROWS = 2_000
#: Parts that the rows of a hot key are dealt to.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else the one that SparkContext.setCheckpointDir() was given."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidied(spark: SparkSession) -> bool:
    """The driver's garbage is collected, and free memory outside its heap, hundreds of MB after many plans, goes back to the system; False where its Java can't do the second."""
    jvm = spark._jvm
    jvm.System.gc()
    beans, commands = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # the server's own class isn't public, its interface is
    (invoke,) = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
    asked = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    asked[0], asked[1] = commands, "systemTrimNativeHeap"
    try:
        invoke.invoke(beans, asked)
    except Py4JJavaError:
        return False
    return True


class Scratch:
    """The written tables of one computation. What its result still reads stays; drop() deletes what nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once, written to the shared folder and read from there: lineage ends here."""
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        # what plans and ended tasks leave goes at once, else the driver's heap grows to its limit before Java collects it
        tidied(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in self.held:
            if any(df is t for t in tables):
                _delete(self.spark, path)
        # Spark deletes the shuffle files of ended jobs when the driver collects their plans
        self.spark._jvm.System.gc()
        self.held = [(df, path) for df, path in self.held if not any(df is t for t in tables)]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """So many rows go to a Python worker at a time while tables are written here: what it holds of whole texts stays small beside the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read from there, for as long as that folder stands."""
    return Scratch(df.sparkSession).saved(df, name)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column doc, beside more: no name of docs can clash with one of more."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *[v.alias(k) for k, v in more.items()])


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in columns])


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, salt_by: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined to groups, one row per key, whose column size tells how many rows the key has.

    The keys with more than hot_rows rows, or with more than a HOT_KEYS-th of all where that is more, are at most
    HOT_KEYS: their table is broadcast, their rows are dealt to SALTS parts by the hash of salt_by, and their groups
    are repeated once per part. Both sides drop out where the other lacks the key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > max(hot_rows, -(-total // HOT_KEYS))).select(key, F.lit(SALTS).alias("parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("part", F.pmod(F.xxhash64(salt_by), F.coalesce("parts", F.lit(1)))).drop("parts")
    each = groups.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    return dealt.join(each, [key, "part"]).drop("part")


def frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts, a written table, of the highest n, at most so many: all from the lowest eighth of a power of two that leaves no more."""
    level = F.floor(8 * F.log2(F.col(n).cast("double")))
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    least, held = None, 0
    for size in sizes:
        held += size.rows
        if held > most:
            break
        least = size.level
    return counts.limit(0) if least is None else counts.filter(level >= least)
