"""Cases of text functions, written out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import facts


def each(spark, values, column, schema="v string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, {schema}").select("n", column.alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_entity_names(spark):
    cases = {
        "Beta Alfa": "alfa beta", "alfa beta gamma": "alfa beta", "Alfa Beta S.r.l.": "alfa beta", "  Rossi SpA ": "rossi", "One Two Three Four": "one two three four",
        "Jean-Luc Picard": "jean-luc picard", "Acme Limited": "acme", "Fondi & Co": "& fondi", "Gamma S.p.A. Ltd": "gamma", "Delta LLC": "delta llc", "": "",
    }
    assert each(spark, list(cases), T.normal_entity(F.col("v"))) == list(cases.values())


def test_noise(spark):
    cases = {
        "12 34": "numeric", "null": "noise_token", "": "noise_token", "nan": "noise_token", None: "noise_token", "marzo 2024": "temporal", "2024 marzo": "temporal", "mar 2024": "temporal", "march": None, "marzo 1824": None,
        "1 option": "ui_fragment", "ok": None, "yes": None, "it12345": "vat_id", "it1234": "vat_id", "it123": None, "bp": None, "3m": None, "rssmra80a01h501u": "tax_code", "123e4567-e89b-12d3-a456-426614174000": "uuid",
    }
    assert each(spark, list(cases), T.entity_noise(F.col("v"))) == list(cases.values())


def test_candidates(spark):
    got = each(spark, ["Mi dai Alfa Beta", "Come Carla Rossi", "AMG", "", None, "What is Acme Corp, Inc?"], T.entity_candidates(F.col("v")))
    assert got[0] == ["Alfa", "Alfa Beta", "Beta"] and got[1] == ["Carla", "Carla Rossi", "Rossi"] and got[2] == ["AMG"] and got[3] == got[4] == []
    assert got[5] == ["Acme", "Acme Corp", "Acme Corp Inc", "Corp", "Corp Inc", "Inc"]


def test_lexical_queries(spark):
    got = each(spark, ["email_from:a@b.com", "foo:bar", "perché più valore", "come e quando", "", None, "TITLE: Big Plan"], T.lexical_query(F.col("v")))
    assert [tuple(r) for r in got] == [("and", "email_from", ["a", "b", "com"]), ("or", None, ["foo", "bar"]), ("or", None, ["valore"]), ("skip", None, []), ("skip", None, []), ("skip", None, []), ("and", "title", ["big", "plan"])]


def test_cosine(spark):
    v = [3.0, 4.0]
    others = [v, [-4.0, 3.0], [-3.0, -4.0], [30.0, 40.0], None, [], [0.0, 0.0], [1.0, 2.0, 3.0], [4.0, 3.0]]
    got = each(spark, others, T.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.col("v")), "v array<double>")
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, [1, 0, 0, 1, 0, 0, 0, 0, 0.96], strict=True))


def test_fingerprints(spark):
    rows = spark.createDataFrame([("ab", ""), ("a", "b"), (None, "ab"), ("", "ab")], "a string, b string").select(T.fingerprint(F.col("a"), F.col("b")).alias("f"))
    one, two, three, four = [r.f for r in rows.collect()]
    assert len({one, two, three}) == 3 and three == four


def test_coverable(spark):
    code = "def f():\n  return 1\nlet x = 2\nplain words in the last of four lines here"
    texts = [None, "| | |", "| | |" * 40, "eighteen chars now", code, "This is plain prose that has far more than fifty characters in it."]
    chunks = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    assert [r.verdict for r in facts.classify_coverable(chunks).orderBy("n").collect()] == ["empty", "empty", "empty", "short", "code", "extractable"]


def test_small_functions(spark):
    assert each(spark, ["conv_summary_1", "doc_summary_1", "live_x", "convXsummaryYz", "claude_session_1"], T.is_derived_chunk(F.col("v"))) == [True, True, True, False, False]
    assert each(spark, ["a_chunk_0001", "a", "doc_x_chunk_12"], T.doc_of_chunk(F.col("v"))) == ["a", "a", "doc_x"]
    assert each(spark, ["2024-01-02T03:04:05Z", "Tue, 2 Jan 2024 03:04:05 +0100", "no date", None], F.date_format(T.parsed_date(F.col("v")), "yyyy-MM-dd HH:mm")) == ["2024-01-02 03:04", "2024-01-02 02:04", None, None]
    assert each(spark, ['"Ann B" <a@b.c>', "<a@b.c>", "a@b.c"], T.short_name(F.col("v"))) == ["Ann B", "a@b.c", "a@b.c"]
    assert each(spark, ["GET /?Token=abc&x=1", "nothing"], T.redact_tokens(F.col("v"))) == ["GET /?Token=REDACTED&x=1", "nothing"]
    assert each(spark, ["  a \n b ", "x" * 70, "word " * 20, "", "ends, " + "y" * 80], T.session_title(F.col("v"))) == ["a b", "x" * 60, ("word " * 12).strip(), "New chat", "ends, " + "y" * 54]
    assert each(spark, ["/data/kb/work/a.md", "/data/other/a.md", "/data/kb/a.md"], T.folder_of(F.col("v"), "kb", "/watch/me")) == ["work", "me", "a.md"]


@pytest.mark.parametrize("text, alnum, mean, known, garbage", [("short", 0.0, 0.0, 0.0, True), ("a b " * 30, 1.0, 1.0, 0.0, False), ("a b " * 60, 1.0, 1.0, 0.0, True), ("the that " * 40, 1.0, 3.5, 1.0, False)])
def test_text_quality(spark, text, alnum, mean, known, garbage):
    got = each(spark, [text], T.quality_stats(F.col("v"), F.array(F.lit("the"), F.lit("that"))))[0]
    assert tuple(got) == (alnum, mean, known, garbage)


def test_fuzzy_ratio(spark):
    import difflib

    pairs = [("The same text", "the same text"), ("abcd" * 60, "abcd" * 60 + "x"), ("red car", "blue bus"), ("", "x"), (None, None)]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a string, b string").select("n", facts.fuzzy_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        a, b = ((x or "").lower()[:100] for x in pairs[r.n])
        assert math.isclose(r.r, difflib.SequenceMatcher(None, a, b).ratio() if b else 0.0)


def test_supersession_candidates_against_all_pairs(spark):
    import difflib

    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(n, f"{words[n % 4]} {words[n % 3]} costs {n % 5} euro a month", f"cat{n % 2}", [f"Tag{n % 3}"], f"2024-01-{n % 28 + 1:02d}", None if n % 9 else n + 1) for n in range(90)]
    df = spark.createDataFrame(rows, "id long, fact string, category string, entity_tags array<string>, created_at string, superseded_by long")
    memo = spark.createDataFrame([(2, 8, "2025-01-01"), (8, 14, "2023-01-01")], "fact_id_a long, fact_id_b long, judged_at string")
    clusters, want = {}, set()
    for r in rows:
        if r[5] is None:
            clusters.setdefault((r[2], r[3][0].lower()), []).append(r)
    for members in clusters.values():
        for i, a in enumerate(members):
            for b in members[i + 1 : i + 20]:
                if difflib.SequenceMatcher(None, a[1].lower(), b[1].lower()).ratio() >= 0.45 and (a[0], b[0]) != (2, 8):
                    want.add((a[0], b[0]))
    got = facts.supersession_candidates(df, memo).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 100


def test_ratio_bounds_lose_no_pair(spark):
    import difflib
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeirt") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 22))) for _ in range(160)] + ["", None, "日本語 text é", "x" * 150, "xy" * 80]
    pairs = [(n, rng.choice(texts), rng.choice(texts)) for n in range(1500)] + [(1500 + n, t, t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "n int, a string, b string").select("n", facts.fuzzy_ratio_from(F.col("a"), F.col("b"), 0.45).alias("r"))
    some = 0
    for r in df.collect():
        a, b = ((x or "").lower()[:100] for x in pairs[r.n][1:])
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if b else 0.0
        assert r.r == (want if want >= 0.45 else 0.0)
        some += want >= 0.45
    assert 200 < some < 1500
    left, right = ([(p[k] or "").lower()[:100] for p in pairs] for k in (1, 2))
    assert facts.common_characters(left, right).tolist() == [facts._subsequence(*p) for p in zip(left, right)]


def test_supersession_limits_take_the_newest_clusters(spark):
    rows = [(n, f"the rent of flat {n % 40} is {n % 7} hundred", f"cat{n % 40}", ["Flat"], "2024-01-01", None) for n in range(1200)]
    df = spark.createDataFrame(rows, "id long, fact string, category string, entity_tags array<string>, created_at string, superseded_by long")
    memo = spark.createDataFrame([], "fact_id_a long, fact_id_b long, judged_at string")
    every = [tuple(r) for r in facts.supersession_candidates(df, memo, per_cluster=60, overall=10**6).collect()]
    newest = {c: max(r[0] for r in rows if f"cat{r[0] % 40}|flat" == c) for c, *_ in every}
    assert len(every) == 40 * 60 and every == sorted(every, key=lambda r: (-newest[r[0]], *r[:3]))
    for overall in (1, 50, 700):
        assert [tuple(r) for r in facts.supersession_candidates(df, memo, per_cluster=60, overall=overall).collect()] == every[:overall]


def test_supersession_compares_no_more_than_the_budget_needs(spark, monkeypatch):
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)

    def counted(a, b, least):
        @F.pandas_udf("double")
        def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
            seen.add(len(x))
            return pd.Series(1.0, index=x.index)

        return ratio.asNondeterministic()(a, b)

    monkeypatch.setattr(facts, "fuzzy_ratio_from", counted)
    rows = [(n, "the rent of a flat", f"cat{n % 2}", ["Flat"], "2024-01-01", None) for n in range(8000)]
    df = spark.createDataFrame(rows, "id long, fact string, category string, entity_tags array<string>, created_at string, superseded_by long")
    memo = spark.createDataFrame([], "fact_id_a long, fact_id_b long, judged_at string")
    got = [(r.a, r.b) for r in facts.supersession_candidates(df, memo, overall=900).collect()]
    assert len(got) == 900 and got[:19] == [(1, 1 + 2 * k) for k in range(1, 20)] and got[500][0] == 0
    assert seen.value <= 2 * 128 * 19


def test_supersession_goes_on_in_a_cluster_until_it_has_its_pairs(spark):
    """Similar facts stand far apart from each other in a long cluster, and its first pairs count."""
    import random

    rng = random.Random(5)
    made = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
    texts = [made() for _ in range(2600)]
    for n in (700, 1500, 2000, 2590):
        texts[n + 3] = texts[n + 5] = texts[n]
    rows = [(n, t, "cat", ["Flat"], "2024-01-01", None) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, fact string, category string, entity_tags array<string>, created_at string, superseded_by long")
    memo = spark.createDataFrame([(700, 703, "2025-01-01"), (700, 705, "2023-01-01"), (700, 705, None)], "fact_id_a long, fact_id_b long, judged_at string")
    want = [(n + x, n + y) for n in (700, 1500, 2000, 2590) for x, y in ((0, 3), (0, 5), (3, 5)) if (n, y - x) != (700, 3)]
    for some in (2, 5, 100):
        got = [(r.a, r.b) for r in facts.supersession_candidates(df, memo, least=0.8, per_cluster=some).collect()]
        assert got == want[:some]
    assert facts.supersession_candidates(df.limit(0), memo).collect() == []


def test_pairs_are_not_dealt_out(spark):
    df = spark.createDataFrame([(n, "f", "cat", ["Flat"], "2024-01-01", None) for n in range(50)], "id long, fact string, category string, entity_tags array<string>, created_at string, superseded_by long")
    memo = spark.createDataFrame([(0, 4, "2025-01-01"), (1, 5, "2023-01-01"), (1, 5, None)], "fact_id_a long, fact_id_b long, judged_at string")
    pairs = facts.candidate_pairs(df, memo).select("cluster", "a", "b")
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(50) for b in range(a + 1, min(a + 20, 50))} - {(0, 4)}
    last = next(x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "run" in last and "fact_id_a" not in last
