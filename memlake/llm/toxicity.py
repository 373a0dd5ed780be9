"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import linear

THRESHOLD = 0.5
EPOCHS = 4
REMEMBERED = 500_000
ABSTAIN = -1
#: Parts of the sample that word lists are mined from, each its own voters.
PARTS = 3
#: Letters of the word beginnings that pattern voters look at.
PREFIXES = (4, 5, 6, 7)
#: Common insults of four languages.
INSULTS = frozenset("""
idiot moron stupid loser pathetic worthless scum trash disgusting dumb jerk fool clown ugly garbage hate filth vermin
abruti connard crétin débile imbécile minable ordure pourriture salaud stupide
abschaum arschloch dreckskerl dummkopf idiotin schwachkopf trottel vollidiot widerlich wertlos
asqueroso basura cretino escoria estúpido gilipollas idiota imbécil inútil payaso
""".split())
ADDRESS = re.compile(r"\b(?:you|your|du|dein|tu|ton|eres|es)\b[^.!?\n]{0,30}\b(?:" + "|".join(sorted(INSULTS)) + r")\b", re.I)

_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’¿¡…"


def distinct_words(text: str | None) -> set[str]:
    return {w.strip(_EDGE) for w in set((text or "").lower().split())}


def beginnings(words: set[str], letters: int) -> set[str]:
    return {w[:letters] for w in words if len(w) > letters}


def families(words: set[str], letters: int) -> set[str]:
    """Beginnings that several of the words share: forms of one stem."""
    counts = Counter(w[:letters] for w in words if len(w) > letters)
    return {b for b, n in counts.items() if n > 1}


def telling(rows: list[set[str]], labels: list[int], least: int = 3, times: int = 20) -> set[str]:
    """Items far likelier in rows of label 1: in at least so many of them, and in more than so many times those of label 0."""
    ones, zeros = Counter(), Counter()
    for items, label in zip(rows, labels, strict=True):
        (ones if label else zeros).update(items)
    return {w for w, n in ones.items() if n >= least and n > times * zeros[w]}


def ballots(words: list[set[str]], texts: list[str], labels: list[int]) -> np.ndarray:
    """Votes of lexicon and pattern voters on each text, in columns: 1, 0 or ABSTAIN.

    Some go by given lists, the others by words and word beginnings mined from the labels of one part of the rows. On
    that part those abstain, so that no label has a say in a vote on its own row.
    """
    insulting = np.array([bool(w & INSULTS) for w in words], bool)
    addressed = np.array([bool(ADDRESS.search(t)) for t in texts], bool)
    shouting = np.array([t.count("!") > 3 for t in texts], bool)
    columns = [insulting.astype(int), addressed.astype(int), np.where(shouting, insulting, ABSTAIN)]
    kinds = [(words, 20), *(([beginnings(w, letters) for w in words], 20) for letters in PREFIXES), *(([families(w, letters) for w in words], 6) for letters in PREFIXES[1:])]
    for part in range(PARTS):
        own = range(part, len(words), PARTS)
        for items, times in kinds:
            lexicon = telling([items[i] for i in own], [labels[i] for i in own], times=times)
            votes = np.array([int(not lexicon.isdisjoint(x)) for x in items], int)
            votes[part::PARTS] = ABSTAIN
            columns.append(votes)
    return np.stack(columns, axis=1)


def correlations(votes: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Between voters, of what expected (the chance of a vote for 1, per vote or voter) leaves, over the rows where both vote."""
    given = votes != ABSTAIN
    left = np.where(given, (votes == 1) - expected, 0.0)
    both = given.astype(float)
    cov, own = left.T @ left, (left * left).T @ both
    return np.clip(cov / np.sqrt(np.maximum(own * own.T, 1e-9)), -1, 1)


#: Voters correlated this much repeat each other.
REPEATED = 0.9
#: Rounds of estimating weights, and steps of expectation maximisation in each, at most; both end when nothing moves.
ROUNDS, STEPS = 20, 200


def label_model(votes: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of label 1, each voter's table P(vote | label), and the voters' correlations given the label.

    votes: rows by voters of 1, 0 or ABSTAIN, which says nothing. A voter's evidence is divided by the sum of its squared
    correlations, of REPEATED or more, with all voters, itself included, so that k copies of a voter count as one: a
    heuristic in place of a likelihood with pairs of voters. The weights come first, from the votes alone; then rounds of expectation
    maximisation with the label hidden, from start or else from the weighted share of votes for 1, and of taking the
    correlations anew from what the posterior leaves, until the weights stay. Voters that are REPEATED whatever the label
    stay repeats, as a label that follows copies would explain them away.
    """
    given = votes != ABSTAIN
    onehot = np.stack([votes == v for v in (0, 1)], axis=2).astype(float)
    plain = correlations(votes, (votes == 1).sum(axis=0) / np.maximum(given.sum(axis=0), 1))
    repeats = np.where(np.abs(plain) >= REPEATED, plain, 0.0)

    def shares(corr: np.ndarray) -> np.ndarray:
        return 1 / np.maximum(1, np.where(np.abs(corr) >= REPEATED, corr**2, 0.0).sum(axis=1))

    weight = shares(plain)
    posterior = ((votes == 1) @ weight + 0.05) / (given @ weight + 0.1) if start is None else start
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            tables = np.stack([np.einsum("r,rjv->jv", p, onehot) + 0.5 for p in (1 - posterior, posterior)])
            tables /= tables.sum(axis=2, keepdims=True)
            prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
            evidence = np.einsum("rjv,jv->r", onehot, (np.log(tables[1]) - np.log(tables[0])) * weight[:, None])
            before, posterior = posterior, 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
            if np.abs(posterior - before).max() < 1e-6:
                break
        left = correlations(votes, np.einsum("lj,lr->rj", tables[:, :, 1], np.stack([1 - posterior, posterior])))
        corr = np.where(np.abs(left) > np.abs(repeats), left, repeats)
        last, weight = weight, shares(corr)
        if np.abs(weight - last).max() < 1e-3:
            break
    return posterior, tables, corr


def word_features(word: str) -> list[int]:
    """Buckets of a word, of its beginnings, and of the insults as one."""
    word = word.strip(_EDGE)
    found = [linear.bucket(word), *(linear.bucket(f"{n} {word[:n]}") for n in PREFIXES if len(word) > n)] if word else []
    return [*found, linear.bucket("an insult")] if word in INSULTS else found


def again(bucket: int) -> int:
    """The bucket that tells that several words of a text have a feature."""
    return (bucket * 0x9E3779B1 + 0x51ED27) % linear.BUCKETS


def example(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    counts = Counter(b for w in set((text or "").lower().split()) for b in word_features(w))
    ids, place = np.unique(np.array([*counts, *(again(b) for b, n in counts.items() if n > 1)], np.int64), return_inverse=True)
    return ids, np.bincount(place, [*(min(n, 3) for n in counts.values()), *(1 for n in counts.values() if n > 1)]).astype(float)


def posterior_labels(texts: list[str], labels: list[int]) -> np.ndarray:
    """The label model's posteriors; it doesn't see the labels, only votes."""
    return label_model(ballots([distinct_words(t) for t in texts], texts, labels))[0]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = linear.SAMPLE_ROWS) -> bytes:
    """Weights as 32-bit floats, learned in one task from at most rows labelled documents that aren't held out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat(list(batches) or [pd.DataFrame({"id": [], "text": [], "label": []})]).sort_values(["id", "text"])
        texts, given = sample["text"].fillna("").tolist(), sample["label"].tolist()
        targets = posterior_labels(texts, given).tolist() if len(set(given)) == 2 else given
        weights = linear.fitted([example(t) for t in texts], targets, EPOCHS, alpha=1.0, l1=5.0, l2=0.1)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()]})

    found = linear.labelled_sample(docs, labels, label, id_col, text_col, rows).mapInPandas(run, "weights binary").first()
    return bytes(found[0]) if found else linear.fitted([], [], 0).astype(np.float32).tobytes()


class Evidence(dict):
    """Word -> the buckets of its features that carry weight, by themselves or if several words have them."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = tuple(b for b in word_features(word) if self.weights[b] or self.weights[again(b)])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def score_toxicity(docs: DataFrame, weights: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted (1 from THRESHOLD) of every row, from its whole text alone.

    Null and empty texts get the score of the constant. Repeated rows each get a score; rows without an id count as
    not held out. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.frombuffer(shared.value, np.float32).astype(float).tolist()
        known = Evidence(w)

        def of(text: str | None) -> float:
            counts = Counter(b for found in map(known.__getitem__, set((text or "").lower().split())) if found for b in found)
            return linear.logistic(sum(w[b] * min(n, 3) + (w[again(b)] if n > 1 else 0.0) for b, n in counts.items()) + w[-1])

        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    rows = docs.select(F.col(id_col), linear.held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
