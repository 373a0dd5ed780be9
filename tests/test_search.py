import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import search
from memlake.plans import fixtures

SF = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi", "du", "pe", "ga")]


def stored(spark):
    rng = random.Random(8)
    rows = []
    for n in range(300):
        text = " ".join(rng.choices(WORDS, weights=range(1, 31), k=rng.choice((0, 3, 20, 90))))
        rows.append((f"conv_summary_{n}" if n % 29 == 0 else f"doc_{n:04d}", f"src{n % 3}", text if n % 17 else None, f"Kata {n % 5}", None, "note", "u1@lota.com" if n % 4 == 0 else "", f"/kb/{rng.choice(WORDS)}.md"))
    return spark.createDataFrame(rows, "chunk_id string, source string, text string, title string, folder string, doc_type string, email_from string, file_path string"), rows


def brute_force(rows, queries, k, source=""):
    """The published formula over all pairs of queries and chunks."""
    words = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    columns = [[words(r[c]) for c in (2, 3, 4, 5, 6, 7)] for r in rows]
    lens = [sum(map(len, c)) for c in columns]
    mean = sum(lens) / len(lens)
    held = [n for n, r in enumerate(rows) if not r[0].startswith("conv_summary_") and (not source or r[1] == source)]
    df = Counter(t for n in held for t in {t for c in columns[n] for t in c})
    out = []
    for q, text in queries:
        field, _, value = text.rpartition(":")
        place = list(T.LEXICAL_COLUMNS).index(field) if field else None
        asked, scores = dict.fromkeys(words(value)), []
        for n in held:
            tf = Counter(t for c in (columns[n] if place is None else [columns[n][place]]) for t in c)
            met = [t for t in asked if tf[t]]
            if met and (place is None or len(met) == len(asked)):
                idf = lambda t: max(math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5)) if df[t] < len(rows) + 0.5 else -1.0, 1e-6)
                s = sum(idf(t) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * lens[n] / mean)) for t in met)
                scores.append((-round(s, 6), rows[n][0]))
        out += [(q, c, -s, place + 1) for place, (s, c) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("share", [(20_000, 4_000, 256), (3, 40, 10)])
def test_bm25_against_all_pairs(spark, monkeypatch, share):
    for name, n in zip(("ASKED", "SCORED", "LEAST_SCORED"), share):
        monkeypatch.setattr(search, name, n)
    chunks, rows = stored(spark)
    rng = random.Random(9)
    asked = [(n, " ".join(rng.choices([*WORDS, "unseen"], k=rng.randint(1, 6)))) for n in range(20)] + [(20, "title:kata 3"), (21, "email_from:U1@lota.com"), (22, "title:kata unseen"), (23, ""), (24, "kata"), (25, "folder:x")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index, lengths = search.term_index(chunks), search.doc_lengths(chunks)
    for source in ("", "src1"):
        want = brute_force(rows, [(q, t) for q, t in asked if t], 7, source)
        got = sorted(search.bm25(queries, index, lengths, 7, source).collect(), key=lambda r: (r.query_id, r.rank))
        assert [(r.query_id, r.chunk_id, r.rank) for r in got] == [(q, c, n) for q, c, _, n in want] and len(want) > 100
        assert all(math.isclose(r.score, w[2], abs_tol=2e-6) for r, w in zip(got, want))
    assert search.bm25(queries, search.term_index(chunks.limit(0)), search.doc_lengths(chunks.limit(0)), 7).collect() == [] == search.bm25(queries.limit(0), index, lengths, 7).collect()


def test_sums_of_queries_and_chunks_stay_in_their_task(spark):
    chunks, _ = stored(spark)
    found = search.bm25(spark.createDataFrame([(1, "kata lodu")], "query_id long, query string"), search.term_index(chunks), search.doc_lengths(chunks), 7)
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("chunk_id" in x for x in dealt)
    assert len(search.term_index(chunks).collect()) == 300


def test_texts_are_not_shuffled_for_vectors_that_nobody_reads(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    chunks = fixtures.table(spark, SF, "chunks")
    texts = chunks.select("chunk_id", "text")
    assert "Join" not in plan(texts) and "Join" in plan(chunks.select("chunk_id", "embedding"))
    assert texts.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    given = spark.read.parquet(f"{SF}/embeddings.parquet")
    left = spark.read.parquet(f"{SF}/documents.parquet").join(given, F.col("vec_id") == F.col("doc_id"), "left")
    assert sorted(map(str, chunks.filter("doc_id % 53 > 0").select("doc_id", "embedding").collect())) == sorted(map(str, left.filter("doc_id % 53 > 0").select("doc_id", "embedding").collect()))
    # a vec_id that comes twice repeats its chunk, as in the SQL
    twice, plain = given.union(given.limit(1)), fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda spark, sf, name: twice if name == "embeddings" else plain(spark, sf, name))
    assert plain(spark, SF, "chunks").select("chunk_id", "text").count() == texts.count() + 1


def test_streams_are_not_made_again_for_what_they_exclude(spark):
    """The semantic stream stands in the plan for itself and for what the entity stream leaves out, the others once."""
    queries, chunks, entities = (fixtures.table(spark, SF, n) for n in ("queries", "chunks", "entity_index"))
    found = search.hybrid_candidates(queries, chunks, entities, 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 3
    rows = [(r.query_id, r.chunk_id) for r in found.collect()]
    assert len(rows) == len(set(rows)) > 0
