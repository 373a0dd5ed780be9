import random
import re

import pytest

import corpus_pipeline
from memlake.llm import near_copies, simhash


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def least_ids(texts):
    """Every pair is compared."""
    sets, group = {i: five(t) for i, t in texts}, {i: i for i, _ in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
    return {i for i in group if group[i] == i}


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for n in range(30):
        base = [word() for _ in range(rng.randint(20, 200))] + passage * (n % 3 == 0)
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 50)):
                base[rng.randrange(len(base))] = word()
    return [*enumerate([*texts, "", None, "one two", "One  TWO", "one two three"])]


@pytest.mark.parametrize("long_list, ordered_by", [(64, 20_000), (3, 20_000), (3, 10)])
def test_all_similar_texts_are_found(spark, long_list, ordered_by):
    texts = made()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    left = near_copies.drop_similar(docs, long_list=long_list, ordered_by=ordered_by)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == least_ids(texts)
    assert len(least_ids(texts)) < len(texts) - 30


def test_the_stage_drops_copies_with_edited_words(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts] + [(None, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.distant_texts(spark, docs, "")
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == least_ids(texts) | {None}
    assert corpus_pipeline.distant_texts(spark, docs.limit(0), "").count() == 0


def test_no_step_without_effect(spark, monkeypatch):
    """The index alone finds every tie, so that no fingerprints are worked out."""
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: 1 / 0)
    docs = spark.createDataFrame(made(), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.drop_similar(docs).collect()} == least_ids(made())


def test_the_stage_drops_texts_that_simhash_links(spark):
    """Fingerprints count what is repeated, sets of shingles don't."""
    refrain = "row row row your boat gently down the stream " * 40
    texts = [(3, refrain + "first of the six verses"), (1, refrain + "this one ends in quite another way"), (2, "all else is new here and nothing of it comes again"), (7, refrain + "and a third end")]
    docs = spark.createDataFrame([*texts, (None, refrain)], "doc_id long, text string")
    assert least_ids(texts) == {1, 2, 3, 7}
    assert sorted(r.component_id for r in simhash.near_duplicates(docs.filter("doc_id > 0")).collect()) == [1, 1, 1, 2]
    assert {r.doc_id for r in corpus_pipeline.distant_texts(spark, docs, "").collect()} == {1, 2, None}
