"""Registered queries against plain versions that compute the same from the tables' rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memlake.llm import linear, quality_model, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


def bucket(text):
    return xxhash.xxh32(text.encode()).intdigest() % 2**18


def odds(score):
    return 1 / (1 + np.exp(-min(30, max(-30, score))))


def plain_toxicity(text, weight):
    """A sum over a dict of features; the beginnings of 4 to 7 letters of each distinct word, and each again if several words have it."""
    counts = Counter()
    for word in set((text or "").lower().split()):
        word = word.strip(toxicity._EDGE)
        if word:
            counts.update([bucket(word)] + [bucket(f"{n} {word[:n]}") for n in (4, 5, 6, 7) if len(word) > n])
        if word in toxicity.INSULTS:
            counts.update([bucket("an insult")])
    return odds(sum(weight[b] * min(n, 3) + (weight[(b * 0x9E3779B1 + 0x51ED27) % 2**18] if n > 1 else 0) for b, n in counts.items()) + weight[2**18])


def plain_quality(text, weight):
    words = (text or "").split()
    if not words:
        return odds(weight[0] + weight[2**18])
    word, form = [bucket(w.lower()) for w in words], [bucket("shape " + quality_model.shape(w)) for w in words]
    pairs = [0x3A5 if a == b else a * 0x9E3779B1 + b for a, b in zip(word, word[1:])]
    shapes = [a * 0x9E3779B1 + b for a, b in zip(form, form[1:])]
    total = weight[2**18]
    for part, salt in ((word, 0), (form, 0x51ED27), (pairs, 0x2C9277), (shapes, 0x17B2A3)):
        for h in part:
            total += weight[((h ^ (h >> 15)) + salt) % 2**18] / len(part)
    return odds(total)


@pytest.mark.parametrize("module, query, label, plain, least", [(toxicity, queries.op1_toxicity, "toxic", plain_toxicity, 0.5), (quality_model, queries.op6_quality_model, "quality", plain_quality, 0.3)])
def test_scores_row_by_row(spark, module, query, label, plain, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weight = np.frombuffer(module.train(docs, labels), np.float32).astype(float)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = query(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id], weight)
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= least) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_labels_of_held_out_rows_and_other_columns_are_not_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(linear.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), flipped)


def test_archives_of_the_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    payloads = {p.page_id: (p.html or "").encode() for p in pages}
    keeper = {}
    for i, data in payloads.items():
        keeper[data] = max(i, keeper.get(data, i))
    rows = queries.op2_warc(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        data = payloads[r.page_id]
        response = keeper[data] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", keeper[data]))
    keys = [(r.urlkey, r.captured, r.page_id) for r in rows]
    assert keys == sorted(keys)


def test_members_of_archives():
    import gzip

    big = bytes(range(256)) * 70_000
    members = [warc.gzip_member(b"one"), warc.gzip_member(big), warc.gzip_member(b"")]
    assert all(m.endswith(b"\0") for m in members)
    data = b"".join(members)
    assert gzip.decompress(data) == b"one" + big and [x for _, x in warc.members(data) if x] == [b"one", big]
    record = warc._record(7, "http://a/", "<p>é</p>", warc.EPOCH, None)
    fields, content = warc.record_at(warc.gzip_member(b"x") + warc.gzip_member(record), len(warc.gzip_member(b"x")))
    assert content == "<p>é</p>".encode() and fields["warc-type"] == "response" and re.fullmatch("sha1:[A-Z2-7]{32}", fields["warc-payload-digest"])
    with pytest.raises(ValueError):
        list(warc.members(data[:-9]))
