"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import linear

THRESHOLD = 0.3
EPOCHS = 3
#: Words that a Python worker remembers the hashes of.
REMEMBERED = 500_000
#: Keeps word, shape, pair and shape-pair features apart.
SALTS = np.array([0, 0x51ED27, 0x2C9277, 0x17B2A3], np.uint64)
_REPEATED = np.uint64(0x3A5)
_SHAPES = ((re.compile(r"[^\W\d_a-zß-öø-ÿ]"), "X"), (re.compile(r"[^\W\d_X]"), "x"), (re.compile(r"\d"), "9"), (re.compile(r"(.)\1+", re.S), r"\1"))


def shape(word: str) -> str:
    """Capitals X, other letters x, digits 9, signs themselves, runs once."""
    for pattern, put in _SHAPES:
        word = pattern.sub(put, word)
    return word[:12]


class Words(dict):
    """Word -> hash of its lower case above the hash of its shape."""

    def __missing__(self, word: str) -> int:
        value = linear.bucket(word.lower()) << 32 | linear.bucket("shape " + shape(word))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_WORDS = Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, shapes, and pairs of both, repeats included, and the weight of each occurrence."""
    words = (text or "").split()
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    both = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    parts = [word, form]
    for h in (word, form):
        pair = h[:-1] * np.uint64(0x9E3779B1) + h[1:]
        parts.append(np.where(word[:-1] == word[1:], _REPEATED, pair) if h is word else pair)
    last = np.uint64(linear.BUCKETS - 1)
    ids = np.concatenate([((p ^ (p >> np.uint64(15))) + salt) & last for p, salt in zip(parts, SALTS, strict=True)])
    return ids.astype(np.int64), np.concatenate([np.full(len(p), 1 / max(1, len(p))) for p in parts])


def example(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    ids, values = features(text)
    ids, place = np.unique(ids, return_inverse=True)
    return ids, np.bincount(place, values)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = linear.SAMPLE_ROWS) -> bytes:
    """Weights as 32-bit floats, learned in one task from at most rows labelled documents that aren't held out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat(list(batches) or [pd.DataFrame({"id": [], "text": [], "label": []})]).sort_values(["id", "text"])
        weights = linear.fitted([example(t) for t in sample["text"]], sample["label"].tolist(), EPOCHS, alpha=2.0, l1=0.02, l2=0.02)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()]})

    found = linear.labelled_sample(docs, labels, label, id_col, text_col, rows).mapInPandas(run, "weights binary").first()
    return bytes(found[0]) if found else linear.fitted([], [], 0).astype(np.float32).tobytes()


def score_quality(docs: DataFrame, weights: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted (1 from THRESHOLD) of every row, from its whole text alone.

    Null and empty texts have one feature of their own. Repeated rows each get a score; rows without an id count as
    not held out. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = np.frombuffer(shared.value, np.float32).astype(np.float64)

        def of(text):
            ids, values = features(text)
            return linear.logistic(float(w[ids] @ values) + w[-1])

        return pd.Series([of(t) for t in texts], dtype="float64")

    rows = docs.select(F.col(id_col), linear.held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
