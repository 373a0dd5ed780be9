import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from memlake.llm import bpe
from memlake.llm.quality_rules import CUTOFF, base_counts
from tests.llm.test_near_copies import least_ids
from tests.llm.test_quality_rules import brute_force, statistics

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """run() against a plain version of all stages, quality by numpy and near copies by comparing every pair."""
    out = corpus_pipeline.run(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs, counts = table.collect(), {r.id: r for r in base_counts(table).collect()}
    fair = [d for d in docs if not counts[d.doc_id].base_failed]
    distances = brute_force([(d.lang, d.source, statistics(counts[d.doc_id])) for d in fair])
    good = {d.doc_id for d, x in zip(fair, distances) if x <= CUTOFF}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for d in docs:
        if d.doc_id in good:
            best[lower(d.text)] = max(d.doc_id, best.get(lower(d.text), -1))
    left = least_ids([(i, t) for t, i in best.items()])
    assert {r.doc_id for r in out} == left and len(out) == len(left) and len({(r.slot, r.doc_id) for r in out}) == len(left)

    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})
    texts = {d.doc_id: d.text for d in docs}
    for r in out:
        ids = other.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_but_the_last_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
