"""Resampling towards a target distribution by hashed word n-grams, bucketed through a head and a tail vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.llm.tables import Scratch, frequent

BUCKETS = 10_000
#: The most frequent words, and pairs of them, whose CRC states and buckets every worker holds. They bound what is broadcast.
HEAD_WORDS, HEAD_PAIRS = 50_000, 100_000
#: Distinct words or pairs that a task counts before it hands its counts on.
HELD = 400_000

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that isn't ASCII, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def _counted(rows: DataFrame, kind: str, update) -> DataFrame:
    """(item, n): what update(counter, text) counts over all rows, added up in each task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def table() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary() if kind == "binary" else pa.int64()), pa.array(list(counts.values()), pa.int64())], ["item", "n"])
            counts.clear()
            return found

        for batch in batches:
            for text in batch.column(0):
                update(counts, text.as_py())
                if len(counts) > HELD:
                    yield table()
        yield table()

    return rows.mapInArrow(run, f"item {kind}, n long").groupBy("item").agg(F.sum("n").alias("n"))


class Head:
    """CRC states of frequent words, and buckets of frequent pairs of words."""

    def __init__(self, common: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.states = {w: crc32(w) for w in common}
        self.pairs = {(a, b): crc32(b, crc32(b" ", self.states[a])) % BUCKETS for a, b in pairs}

    def features(self, found: list[bytes]) -> np.ndarray:
        """The bucket of each word and of each pair of neighbours; what isn't in the head takes its CRC from its bytes."""
        states = [crc32(w) if s is None else s for w, s in zip(found, map(self.states.get, found))]
        pairs = list(map(self.pairs.get, zip(found, found[1:])))
        for k, b in enumerate(pairs):
            if b is None:
                pairs[k] = crc32(found[k + 1], crc32(b" ", states[k])) % BUCKETS
        return np.concatenate([np.array(states, np.uint32) % BUCKETS, np.array(pairs, np.uint32)]).astype(np.uint16)


def head_vocabulary(texts: DataFrame, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words of all texts (one column), and the most frequent pairs of neighbours among them."""
    scratch = Scratch(texts.sparkSession)

    def top(counts: DataFrame, n: int) -> list:
        counts = scratch.saved(counts, "counts")
        found = [r.item for r in frequent(counts, "n", n).select("item").collect()]
        scratch.drop(counts)
        return found

    common = [bytes(w) for w in top(_counted(texts, "binary", lambda counts, text: counts.update(words(text))), n_words)]
    shared = texts.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(common)})
    span = len(common) + 1

    def pairs(counts: Counter, text: str | None) -> None:
        at = np.array(list(map(lambda w, get=shared.value.get: get(w, -1), words(text))), np.int64)
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        counts.update((at[:-1][both] * span + at[1:][both]).tolist())

    return Head(common, [(common[p // span], common[p % span]) for p in top(_counted(texts, "long", pairs), n_pairs)])


def bucketed(rows: DataFrame, head: Head) -> DataFrame:
    """rows (…, text) with n_words and features, the buckets as 16-bit numbers, in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(head)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column("text"):
                w = words(text.as_py())
                sizes.append(len(w))
                found.append(shared.value.features(w).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], [*(f.name for f in kept), "n_words", "features"])

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "n_words long", "features binary"]))


def bucket_totals(rows: DataFrame) -> np.ndarray:
    """How many features of all rows fall into each bucket: BUCKETS sums, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for f in batch.column("features"):
                total += np.bincount(np.frombuffer(f.as_py(), np.uint16), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    total = np.zeros(BUCKETS)
    for bucket, n in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket, floored."""
    ratio = ((target + 1) * (source.sum() + BUCKETS)) / ((source + 1) * (target.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per row of docs: id_col, n_features, n_words, weight, score, rank (1 for the highest score; null if not drawn).

    Words and pairs of neighbours are hashed into buckets; a bucket's gain is the log ratio of its shares in target and
    in docs, and a row's weight the mean gain of its features. Of the rows with least_words or more, percent in a
    hundred are drawn without replacement, in proportion to the weights, by adding noise from a hash of seed and id;
    ties go to the smaller id, null ids last. Null and empty texts have no features and a weight of 0; so have all rows'
    gains their smoothed values where target or docs have no texts at all. Repeated rows each get a row and may take
    ranks of their own. An empty table gives an empty table. Scores are whole numbers between bounds that don't grow
    with the rows, so that ranks are an offset for each score and a place within it, without a sort in one task.
    """
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    texts, wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), target.select(F.col(text_col).alias("text"))
    head = head_vocabulary(texts.select("text"), n_words, n_pairs)
    rows = scratch.saved(bucketed(texts, head), "features")
    shared = spark.sparkContext.broadcast(gains(bucket_totals(rows), bucket_totals(bucketed(wanted, head))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f.as_py(), np.uint16) for f in batch.column("features")]
            weights = [int(shared.value[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(list(map(len, found)), pa.int64()), pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

    id_type = rows.schema["id"].dataType.simpleString()
    weighed = rows.mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")
    noise = f"floor(-1000D * ln(-ln((CAST(conv(substring(sha2(concat('{seed}:', coalesce(CAST(id AS string), '')), 256), 1, 8), 16, 10) AS DOUBLE) + 0.5D) / 4294967296D)))"
    scored = scratch.saved(weighed.withColumn("score", F.expr(f"weight + CAST({noise} AS LONG)")), "scores")
    scratch.drop(rows)

    fit = scored.filter(F.col("n_words") >= least_words)
    # some 200,000 scores at most: gains of 64-bit counts and noise of 32-bit hashes, in thousandths
    counts = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    counts.sort(key=lambda r: -r.score)
    drawn = percent * sum(r.n for r in counts) // 100
    before = np.cumsum([0, *(r.n for r in counts)]).tolist()
    offsets = spark.createDataFrame([(r.score, b) for r, b in zip(counts, before) if b < drawn], "score long, before long")
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col("id").asc_nulls_last())).cast("long")
    ranked = fit.join(F.broadcast(offsets), "score").withColumn("rank", F.col("before") + place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("before")
    last = min((r.score for r, b in zip(counts, before) if b < drawn), default=None)
    others = scored if last is None else scored.filter((F.col("n_words") < least_words) | (F.col("score") < last))
    columns = ["id", "n_features", "n_words", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(others.withColumn("rank", F.lit(None).cast("long")).select(columns)).withColumnRenamed("id", id_col)
