import corpus_pipeline
from memlake.llm import mixing
from memlake.llm.tables import saved


def test_rows_carry_their_place_in_the_mix(spark):
    """Through files, as in run(): by slot, each source has its share of the blocks, to less than one block."""
    sizes = {"a": 6400, "b": 1600, "c": 400, None: 100}
    rows = [(s, n) for s, k in sizes.items() for n in range(k)]
    docs = spark.createDataFrame([(n, f"text {n} of {s}", "en", s, 9) for n, (s, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    mix = saved(corpus_pipeline.mixed_sources(spark, docs.repartition(3), ""), "mix")
    out = saved(corpus_pipeline.token_ids(spark, mix, ""), "ids")
    assert out.columns == ["doc_id", "slot", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(rows)
    slots = {r.doc_id: r.slot for r in out.collect()}
    assert slots == {r.doc_id: r.slot for r in mixing.scheduled(docs).collect()}
    source = {t: rows[i][0] for i, t in slots.items()}
    weight = {s: k**0.5 for s, k in sizes.items()}
    last = min(max(t for t, x in source.items() if x == s) for s in sizes)
    for t in range(last):
        for s in sizes:
            assert abs(sum(x == s for u, x in source.items() if u <= t) - weight[s] / sum(weight.values()) * (t + 1)) < 1.01
