"""Logistic regression on hashed features, learned on a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those of the least hashes of their ids.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, label) of at most rows labelled documents in one partition, none of them held out; of rows that repeat an id, the first text."""
    learnable = labels.filter(~held_out(F.col(id_col)) & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    picked = learnable.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    picked = picked.groupBy("__id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(picked), F.col("id") == F.col("__id")).groupBy("id", "label").agg(F.min("text").alias("text"))
    return found.select("id", "text", "label").repartition(1)


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def logistic(score: float) -> float:
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, score))))


class FollowRegularisedLeader:
    """Follow-the-regularised-leader updates for log loss, with a rate for each coordinate."""

    def __init__(self, size: int = BUCKETS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, np.full(size + 1, l1), l2
        self.l1[size] = 0  # the last coordinate is the constant

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, ids: np.ndarray, values: np.ndarray, target: float) -> None:
        """ids: distinct; target: the label, or its probability."""
        ids, values = np.append(ids, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(ids)
        gradient = (logistic(float(w @ values)) - target) * values
        grown = self.n[ids] + gradient**2
        self.z[ids] += gradient - (np.sqrt(grown) - np.sqrt(self.n[ids])) / self.alpha * w
        self.n[ids] = grown


def fitted(examples: list[tuple[np.ndarray, np.ndarray]], targets: list[float], epochs: int, **options) -> np.ndarray:
    """Weights, the constant last. Without examples of both kinds every score is the smoothed share of ones."""
    if not targets or min(targets) == max(targets):
        w = np.zeros(BUCKETS + 1)
        share = (sum(targets) + 1) / (len(targets) + 2)
        w[-1] = np.log(share / (1 - share))
        return w
    model, order = FollowRegularisedLeader(**options), np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(targets)):
            model.learn(*examples[k], targets[k])
    return model.weights()
