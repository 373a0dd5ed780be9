"""Vectors in a grid of parts and in cells, against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import lifecycle, search, vectors

rng = np.random.default_rng(5)
GROUPS = rng.standard_normal((60, 24))
POINTS = (GROUPS[rng.integers(0, 60, 900)] + 0.35 * rng.standard_normal((900, 24))).astype(np.float32)
UNIT = POINTS.astype(float) / np.linalg.norm(POINTS.astype(float), axis=1, keepdims=True)


@pytest.fixture(scope="module")
def chunks(spark):
    # a third of all rows share one time
    rows = [(f"c{n:04}", POINTS[n].tolist(), 500.0 if n % 3 == 0 else float(n), "x" * (60 if n % 7 else 10), "later" if n % 11 == 0 else "") for n in range(len(POINTS))]
    rows += [("none", None, 1.0, "x" * 60, ""), ("empty", [], 1.0, "x" * 60, ""), ("zero", [0.0] * 24, 2.0, "x" * 60, ""), ("other", [1.0, 2.0], 3.0, "x" * 60, "")]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, create_time double, text string, superseded_by string").cache()


@pytest.fixture
def small_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARE", 100)
    monkeypatch.setattr(vectors, "LEAST_SHARE", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k_in_a_grid(spark, chunks, small_parts):
    queries = chunks.filter("substring(chunk_id, 5, 1) IN ('1', '2', '3')").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.chunk_id for r in search.vector_topk(queries, chunks, 4).collect()}
    names = [f"c{n:04}" for n in range(len(POINTS))]
    for q in (n for n in range(len(POINTS)) if n % 10 in (1, 2, 3)):
        s = np.round(np.maximum(UNIT @ UNIT[q], 0), 6)
        order = sorted(range(len(POINTS)), key=lambda n: (-s[n], names[n]))[:4]
        assert [got[names[q], k + 1] for k in range(4)] == [names[n] for n in order]
    a, b = vectors._grid(vectors.vector_rows(queries, "query_id"), vectors.vector_rows(chunks, "chunk_id"), 100)
    for side in (a, b):
        cells = side.groupBy("cell", "i", "j").count().collect()
        assert len(cells) > 20 and max(r["count"] for r in cells) < 2 * 100


def older_pairs(least, k):
    t = np.array([500.0 if n % 3 == 0 else float(n) for n in range(len(POINTS))])
    able = np.array([n % 7 != 0 and n % 11 != 0 for n in range(len(POINTS))])
    s, out = np.round(UNIT @ UNIT.T, 6), set()
    for n in range(len(POINTS)):
        found = [m for m in np.flatnonzero(able & (t < t[n]) & (s[n] >= least))]
        out |= {(f"c{n:04}", f"c{m:04}") for m in sorted(found, key=lambda m: (-s[n][m], m))[:k]}
    return out


def test_older_neighbours_in_parts_by_time(chunks, small_parts):
    got = {(r.chunk_id, r.older_id) for r in lifecycle.chunk_supersession_candidates(chunks, 3, 0.6).collect()}
    assert got == older_pairs(0.6, 3)
    rows = vectors.vector_rows(chunks, "chunk_id", times="create_time")
    for side in vectors._by_time(rows, rows, 100):
        cells = side.groupBy("i", "j").count().collect()
        assert len(cells) > 20 and max(r["count"] for r in cells) < 2 * 100


def test_cells_find_nine_in_ten(chunks, small_parts):
    want = older_pairs(0.82, 5)
    got = {(r.chunk_id, r.older_id) for r in lifecycle.chunk_supersession_candidates(chunks, 5, 0.82, tables=12, bits=6).collect()}
    assert len(want) > 1_000 and len(got & want) / len(want) > 0.95
    # every pair found is a pair indeed
    s = {(a, b): UNIT[int(a[1:])] @ UNIT[int(b[1:])] for a, b in got}
    assert min(s.values()) >= 0.8199


def test_empty_sides(spark, chunks):
    none = chunks.limit(0)
    assert search.vector_topk(none.withColumnRenamed("chunk_id", "query_id"), chunks, 3).collect() == []
    assert lifecycle.chunk_supersession_candidates(none).collect() == [] == lifecycle.chunk_supersession_candidates(none, tables=4).collect()
