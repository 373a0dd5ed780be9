"""op13: probabilities against a plain Kneser-Ney model in dicts, held-out accuracy, rejection, odd texts."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from memlake.llm import language_id as L
from memlake.llm import queries
from memlake.llm.tables import Scratch

SF = "/root/testdata/sf0.01"


def plain_model(words):
    """Probability of a character after up to four others, by dicts of strings; a boundary is a NUL."""
    level = Counter(("\0" * 4 + w + "\0")[k : k + 5] for w, n in words.items() for k in range(len(w) + 1) for _ in range(n))
    levels = {5: level}
    for order in (4, 3, 2, 1):
        levels[order] = level = Counter(g[1:] for g in level)
    rates, totals, kinds = {}, {}, {}
    for order, level in levels.items():
        ones, twos = (sum(n == k for n in level.values()) for k in (1, 2))
        rates[order] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        totals[order], kinds[order] = Counter(), Counter()
        for g, n in level.items():
            totals[order][g[:-1]] += n
            kinds[order][g[:-1]] += 1

    def p(gram):
        out = 2.0**-12
        for order in range(1, 6):
            g = gram[-order:]
            if total := totals[order][g[:-1]]:
                out = (max(levels[order][g] - rates[order], 0) + rates[order] * kinds[order][g[:-1]] * out) / total
        return out

    return p


def key(gram):
    out = 0
    for c in gram:
        out = out << 12 | (1 + ord(c) % 4095 if c != "\0" else 0)
    return out


def test_probabilities_equal_a_plain_model(spark):
    texts = {"a": "the then there theory other another bother ñu", "b": "der die das dieser jener anderer über"}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items() for _ in range(3)] + [("a", "the the them")], "lang string, text string")
    models = L.learned(L.gram_counts(L.word_counts(rows)), Scratch(spark))
    for lang in "ab":
        words = Counter(w for r in rows.collect() if r.lang == lang for w in r.text.split())
        p = plain_model(words)
        grams = ["\0\0\0\0t", "\0\0\0th", "\0\0the", "\0the\0", "other", "xother"[-5:], "zzzzz", "\0\0\0\0q", "nothe", "ieser", "\0\0\0üb", "\0\0\0ñu"]
        np.testing.assert_allclose(models[lang].probability(np.array([key(g) for g in grams])), [p(g) for g in grams], rtol=1e-9)
        # the probabilities of all characters after a context add up to one
        for context in ("\0\0\0t", "\0the", "othe", "zzzz"):
            assert abs(models[lang].probability((key(context) << 12) + np.arange(4096)).sum() - 1) < 1e-9


def test_fewer_entries_leave_a_distribution(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL")
    models = L.learned(L.gram_counts(L.word_counts(rows)), Scratch(spark), entries=2_000)
    assert max(sum(len(m.levels[o][0]) for m in models.values()) for o in range(L.ORDER)) <= 2_000
    for m in models.values():
        for context in ("\0\0\0t", "\0the", "xxxx"):
            assert abs(m.probability((key(context) << 12) + np.arange(4096)).sum() - 1) < 1e-9


def test_bits_of_a_text_are_those_of_its_words(spark):
    rows = spark.createDataFrame([("a", "ab abc b")], "lang string, text string")
    models = L.learned(L.gram_counts(L.word_counts(rows)), Scratch(spark))
    p = plain_model(Counter(["ab", "abc", "b"]))
    found = L.measured(spark.createDataFrame([(1, "Abc, ab!")], "id long, text string"), models).first()
    assert found.chars == 7 and abs(found.bits + sum(np.log2(p(("\0" * 4 + w + "\0")[k : k + 5])) for w in ("abc", "ab") for k in range(len(w) + 1))) < 1e-9


def test_few_entries_lose_no_n_gram(spark, monkeypatch):
    """Bits are those of the whole models, whatever number of entries a task holds and of words is broadcast."""
    rows = spark.createDataFrame([("a", "the then there theory other another bother ñu"), ("b", "der die das dieser jener anderer über"), ("b", "der die")], "lang string, text string")
    asked = spark.createDataFrame([(1, "the other die"), (1, "über, Über zz"), (2, None), (3, "12 !"), (4, "ñuthe bdieser the the"), (None, "das")], "id long, text string")
    grams = L.gram_counts(L.word_counts(rows))
    told = lambda found: sorted((r.id or 0, r.lang_pred, r.chars, round(r.bits, 5), round(r.margin, 5)) for r in found.collect())
    whole = told(L.measured(asked, L.learned(grams, Scratch(spark))))
    for held in (10**6, 12, 0):
        monkeypatch.setattr(L, "COSTS", held)
        assert told(L.measured(asked, L.learned(grams, Scratch(spark), entries=8))) == whole


def test_rare_n_grams_are_asked_once(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "the then there theory other another"), ("b", "der die das dieser jener anderer")], "lang string, text string")
    monkeypatch.setattr(L, "COSTS", 12)
    models = L.learned(L.gram_counts(L.word_counts(rows)), Scratch(spark), entries=8)
    assert 0 < len(models.head[0]) <= 4
    asked, costs = [], L.event_costs
    monkeypatch.setattr(L, "event_costs", lambda keys, models: asked.extend(r.key for r in keys.collect()) or costs(keys, models))
    L.measured(spark.createDataFrame([(k, f"the other{'x' * (k % 7)} die die " * 50) for k in range(40)], "id long, text string"), models).collect()
    words = ["the", "die", *(f"other{'x' * k}" for k in range(7))]
    every = set(L.grams([w.encode() for w in words])[0].tolist())
    assert sorted(asked) == sorted(every - set(models.head[0].tolist()))


def test_held_out_accuracy_and_fold(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.lang_pred == docs[r.doc_id].lang, r.accepted) for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([right for right, _ in judged]) > 0.99 and np.mean([accepted for _, accepted in judged]) > 0.97


def test_odd_texts(spark):
    said = {"en": "the cat sat on the mat with another cat", "de": "der hund und die katze sitzen auf der matte"}
    learn = [(k, " ".join(said[lang].split()[k % 5 :] + said[lang].split()[: k % 7]), lang) for k in range(80) for lang in ["en" if k % 2 else "de"]]
    odd = [(1001, None), (1002, ""), (1003, "12 34 !!"), (1004, "—«»"), (1005, "the " * 100_000), (None, "die katze"), (1005, "the " * 100_000), (1006, "Ж"), (1007, "y" * 200_000), (1008, "a\0b \0")]
    docs = spark.createDataFrame([(*r, 1.0) for r in learn + [(i, t, None) for i, t in odd]], "doc_id long, text string, lang string, score double")
    found = defaultdict(list)
    for r in L.identify(docs, L.train(docs)).collect():
        found[r.doc_id].append(r)
    assert all(found[i][0].lang_pred == L.UNKNOWN and found[i][0].score == 0 and not found[i][0].accepted for i in (1001, 1002, 1003, 1004))
    assert [r.lang_pred for r in found[1005]] == ["en", "en"] and found[None][0].lang_pred == "de" and not found[None][0].held_out
    assert found[1006][0].lang_pred in ("de", "en") and not found[1007][0].accepted
    nothing = docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang IS NULL")
    assert {r.lang_pred for r in L.identify(nothing, L.train(nothing)).collect()} == {L.UNKNOWN}
    assert L.identify(docs.limit(0), L.train(docs)).collect() == []


def test_calibration_never_falls():
    assert L.rising([0.1, 0.5, 0.3, 0.9], [1, 1, 3, 1]) == [0.1, 0.35, 0.35, 0.9]
