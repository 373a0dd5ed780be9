"""op11 against a plain version that hashes each feature's bytes."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from memlake.llm import importance, queries

SF = "/root/testdata/sf0.001"


def plain(docs, target, percent=25, least=20):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


def test_query_equals_plain_hashing(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert Counter((i, n, w, s, r) for i, n, _, w, s, r in expected.elements()) == Counter(map(tuple, queries.op11_importance(spark, SF).collect()))


def test_head_of_any_size_gives_the_same_rows(spark):
    texts = ["Alpha beta, alpha BETA 42 " * 9, "ñandú É été " * 8, "", None, " ,.; ", "x" * 300_000, "one two three four five " * 4, "one two three four five " * 4, "z " * 50_000]
    rows = [(k, t, "other") for k, t in enumerate(texts)] + [(None, texts[0], "no id"), (0, texts[0], "repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target = spark.createDataFrame([("alpha beta gamma",), (None,)], "text string")
    expected = plain([r[:2] for r in rows], ["alpha beta gamma", None], percent=60)
    for n_words, n_pairs in ((50_000, 100_000), (3, 2), (0, 0)):
        found = importance.importance_sample(docs, target, percent=60, n_words=n_words, n_pairs=n_pairs)
        assert Counter(map(tuple, found.collect())) == expected


def test_ranks_follow_scores_without_gaps(spark):
    rows = queries.op11_importance(spark, SF).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and all((-a.score, a.doc_id) < (-b.score, b.doc_id) for a, b in zip(rows, rows[1:]))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_sample(none, docs).collect() == []
    assert [r["rank"] for r in importance.importance_sample(docs, none).collect()] == [None]
    assert importance.importance_sample(docs, none, least_words=0, percent=100).select(F.max("rank")).first()[0] == 1
