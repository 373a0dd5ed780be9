"""Cosine search by matrix products, in a grid of parts of both sides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as T


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", vector: str = "embedding") -> DataFrame:
    """df with vector, what embed gives for each text, cut to the length that is embedded; embed is called once per Arrow batch and loaded once per task."""

    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in embed(texts.tolist())], dtype=object)

    return df.withColumn(vector, of(T.embedding_text(F.col(text))))


#: Vectors of a side that a task holds at most, about, and at least where there are fewer tasks than could run.
SHARE, LEAST_SHARE = 2_000, 256


def vector_rows(df: DataFrame, key: str, vector: str = "embedding", times: str = "") -> DataFrame:
    """(k, v, t, cell): rows with a vector, which is null or empty in none; cell is its size, as only vectors of one size meet."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(times).cast("double") if times else F.lit(0.0)).alias("t"))
    return rows.filter("size(v) > 0").withColumn("cell", F.size("v").cast("long"))


def _grid(a: DataFrame, b: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """a and b with i and j: in each cell a's rows are dealt to parts i and b's to parts j of share rows or so, and each row goes to all cells of its row or column of that grid.

    Rows whose cell the other side lacks, or whose time leaves them no older row or no newer one, drop out.
    """
    of = lambda df, n, t, m: df.groupBy("cell").agg(F.count(F.lit(1)).alias(n), m("t").alias(t))
    sizes = of(a, "n", "latest", F.max).join(of(b, "m", "earliest", F.min), "cell")
    sizes = sizes.select("cell", "latest", "earliest", *[F.ceil(F.col(c) / share).cast("long").alias(p) for c, p in (("n", "rows"), ("m", "columns"))])
    part = lambda parts: F.pmod(F.xxhash64("k"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    a = a.join(sizes, "cell").withColumn("i", part("rows")).withColumn("j", every("columns"))
    b = b.join(sizes, "cell").withColumn("j", part("columns")).withColumn("i", every("rows"))
    return a, b


def _by_time(rows: DataFrame, older: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """rows and older with i and j, parts of share rows or so that are cut by time; a part of older goes only to the parts of rows that aren't all earlier.

    A time that has more rows than a part is dealt to several. The driver holds a number for each part.
    """
    n = max(1, -(-rows.count() // share))
    bounds = np.array(sorted(set(rows.approxQuantile("t", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else [])))

    @F.pandas_udf("int")
    def span(t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, t.to_numpy(), side="right"))

    rows, older = rows.withColumn("span", span("t")), older.withColumn("span", span("t"))
    held = {r.span: r["count"] for r in rows.groupBy("span").count().collect()}
    parts = [max(1, -(-held.get(k, 0) // share)) for k in range(len(bounds) + 1)]
    first = np.cumsum([0, *parts]).tolist()
    at = lambda values, k: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("span") + k)
    own = F.pmod(F.xxhash64("k"), at(parts, 1)) + at(first, 1)
    a = rows.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), at(first, 2) - 1)))
    b = older.withColumn("j", own).withColumn("i", F.explode(F.sequence(at(first, 1), F.lit(first[-1] - 1).cast("long"))))
    return a, b


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    lists = vectors.combine_chunks()
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(a: DataFrame, b: DataFrame, k: int, names: tuple[str, str], score: Callable[[np.ndarray], np.ndarray], able: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None) -> DataFrame:
    """(names, score): in each cell of the grid (cell, i, j), for each row of a its k best partners in b, by rounded score, of equals the least key."""
    kinds = [df.schema["k"].dataType.simpleString() for df in (a, b)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        if left.num_rows and right.num_rows:
            s = np.round(score(_units(left["v"]) @ _units(right["v"]).T), 6)
            fit = np.ones_like(s, bool) if able is None else able(s, left["t"].to_numpy(), right["t"].to_numpy())
            keys = np.array(right["k"].to_pylist(), object)
            for n, own in enumerate(left["k"].to_pylist()):
                found = np.flatnonzero(fit[n])
                if len(found) > k:
                    found = found[s[n][found] >= np.partition(s[n][found], -k)[-k]]
                    found = np.array(sorted(found, key=lambda m: (-s[n][m], keys[m]))[:k])
                for column, values in zip(out, ([own] * len(found), keys[found].tolist(), s[n][found].tolist())):
                    column.extend(values)
        return pa.table([pa.array(out[0], left.schema.field("k").type), pa.array(out[1], right.schema.field("k").type), pa.array(out[2], pa.float64())], [*names, "score"])

    sides = [df.select("cell", "i", "j", "k", "v", "t").groupBy("cell", "i", "j") for df in (a, b)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, f"{names[0]} {kinds[0]}, {names[1]} {kinds[1]}, score double")


def share_of(rows: DataFrame) -> int:
    """Rows for each task of those that can run side by side, between LEAST_SHARE and SHARE."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SHARE, min(SHARE, -(-rows.count() // tasks)))


def nearest(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): for queries and chunks (id, embedding), the k chunks of greatest cosine, at least 0, out of each part of the chunks.

    A grid of parts of the queries and parts of the chunks: each cell is a task of its own that multiplies two matrices.
    """
    a, b = vector_rows(queries, "query_id"), vector_rows(chunks, "chunk_id")
    return _best(*_grid(a, b, share_of(b)), k, ("query_id", "chunk_id"), lambda s: np.maximum(s, 0.0), None)


def older_neighbours(rows: DataFrame, older: DataFrame, k: int, least: float, names: tuple[str, str]) -> DataFrame:
    """(names, score): for rows (k, v, t, cell) the k nearest of older ones before them in time out of each part, with a cosine of least or more."""
    return _best(*_by_time(rows, older, share_of(rows)), k, names, lambda s: s, lambda s, new, old: (old[None, :] < new[:, None]) & (s >= least))


def hyperplane_cells(rows: DataFrame, tables: int, bits: int, probes: int = 0, seed: int = 11) -> DataFrame:
    """rows (k, v, t, cell) once for each table, under a cell that tells on which sides of bits random hyperplanes the vector lies.

    With probes, also under the cells beyond the hyperplanes that are nearest to the vector, so many for each table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = np.zeros((batch.num_rows, tables * (1 + probes)), np.int64)
            sizes = batch.column("cell").to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                side = (_units(pa.chunked_array([batch.column("v").take(pa.array(at))])) @ planes[dim]).reshape(len(at), tables, bits)
                sign = ((side > 0) << np.arange(bits)).sum(axis=2)
                near = np.argsort(np.abs(side), axis=2)[:, :, :probes]
                every = np.concatenate([sign[:, :, None], sign[:, :, None] ^ (1 << near)], axis=2)
                cells[at] = ((every << 8 | np.arange(tables)[None, :, None]) << 16 | dim % (1 << 16)).reshape(len(at), -1)
            lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), cells.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), batch.column("t"), batch.column("cell"), lists], ["k", "v", "t", "cell", "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("k", "v", "t", "cell").schema)
    return rows.select("k", "v", "t", "cell").mapInArrow(run, f"{kinds}, cells array<long>").select("k", "v", "t", F.explode("cells").alias("cell"))


def likely_older_neighbours(rows: DataFrame, older: DataFrame, k: int, least: float, names: tuple[str, str], tables: int, bits: int, probes: int) -> DataFrame:
    """older_neighbours() among vectors that share a cell of hyperplane_cells() in one of tables; cells with more than SHARE rows are cut like a grid."""
    a, b = hyperplane_cells(rows, tables, bits, probes), hyperplane_cells(older, tables, bits)
    a, b = _grid(a, b, SHARE)
    a, b = a.filter("t > earliest"), b.filter("t < latest")
    return _best(a, b, k, names, lambda s: s, lambda s, new, old: (old[None, :] < new[:, None]) & (s >= least)).distinct()
