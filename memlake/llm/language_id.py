"""Language identification: a character model per language by interpolated Kneser-Ney smoothing, in sorted hash arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import Scratch, frequent

UNKNOWN = "und"
#: Characters of an n-gram, and bits of the hash of one: an n-gram's hash is those of its characters, side by side.
ORDER, BITS = 5, 12
#: Entries of each order that the models of all languages have together at most, as every task holds them. Where there are more, n-grams are looked up in parts of the whole models.
ENTRIES = 400_000
#: Costs of frequent n-grams that every task holds then, a number for each language.
COSTS = 1_000_000
#: Costs from parts are whole numbers of this share of a bit, so that sums are the same in any order.
UNIT = 2.0**-24
LANGUAGES = 1_000
#: Words that a Python worker remembers the costs of, and distinct words that a task counts before it hands them on.
REMEMBERED, HELD = 200_000, 400_000
#: Characters of texts that are scored together, about.
TOGETHER = 1_000_000
#: One of so many learnable texts is kept from the counts, for calibration.
CALIBRATED = 8
#: Margins, in bits, are met in so many classes of eighths of a power of two.
MARGINS = 128
#: Texts of a class that the models' own odds count as.
PRIOR = 4
#: The ceiling of bits a character: so many deviations above the mean of a language and length.
DEVIATIONS = 5
#: Texts of a length that those of all lengths of the language count as, in that mean and deviation.
BORROWED = 20
#: Stands for all lengths.
ANY = -1

_FOLDED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and of all that isn't ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of each word and at its end, and the place of each in found.

    A word stands between boundaries; a character is hashed to 1 to 4095, a boundary to 0.
    """
    margin = "\0" * (ORDER - 1)
    joined = margin + "".join(w.decode("utf-8", "surrogatepass").replace("\0", " ") + margin for w in found)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(code > 0, 1 + code % ((1 << BITS) - 1), 0)
    last, before = code[ORDER - 1 :], code[ORDER - 2 : -1]
    event = (last > 0) | (before > 0)
    key = np.zeros(len(last), np.int64)
    for k in range(ORDER):
        key = key << BITS | code[k : len(code) - ORDER + 1 + k]
    ends = (last == 0) & (before > 0)
    return key[event], (np.cumsum(ends) - ends)[event]


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text), added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def tables() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                counts.setdefault(lang.as_py(), Counter()).update(words(text.as_py()))
                if sum(map(len, counts.values())) > HELD:
                    yield from tables()
        yield from tables()

    return rows.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(lang, key, a) of word_counts(): how often each n-gram of the highest order stands in a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, n = np.array(batch.column("lang").to_pylist(), object), batch.column("n").to_numpy()
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                key, place = grams([batch.column("word")[i].as_py() for i in at.tolist()])
                key, back = np.unique(key, return_inverse=True)
                total = np.bincount(back, n[at][place]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(total)], ["lang", "key", "a"])

    return counts.mapInArrow(run, "lang string, key long, a long").groupBy("lang", "key").agg(F.sum("a").alias("a"))


class Model:
    """Discounted shares of the n-grams of each order, and what each context leaves to the lower order, of one language."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """tables: for each order from 1, hashes and shares."""
        self.levels = []
        for key, share in tables:
            order = np.argsort(key)
            key, share = key[order], share[order]
            context, start = np.unique(key >> BITS, return_index=True)
            left = 1 - np.add.reduceat(share, start) if len(key) else share
            self.levels.append((key, share, context, left))

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def probability(self, key: np.ndarray) -> np.ndarray:
        """Of each n-gram's last character after the ones before it; what no order has shares the rest evenly."""
        p = np.full(len(key), 2.0**-BITS)
        for order, (keys, shares, contexts, left) in enumerate(self.levels, 1):
            part = key & ((1 << BITS * order) - 1)
            p = self._found(keys, shares, part, 0.0) + self._found(contexts, left, part >> BITS, 1.0) * p
        return p


class Models(dict):
    """Models by language. Where they lack n-grams, rest has all of the k-th language, (order, k, key, share), and head the costs of those that are learned most often; else None."""

    rest: DataFrame | None = None
    head: tuple[np.ndarray, np.ndarray] | None = None


def learned(counts: DataFrame, scratch: Scratch, entries: int = ENTRIES) -> Models:
    """A model for each language of gram_counts().

    The highest order goes by counts, each lower one by how many characters stand before its n-grams. All n-grams make
    up the totals of contexts and the discounts. An order of no more than entries n-grams is kept whole; of others the
    models have those that have, of all counts of their order and language, one in entries over the number of languages,
    so that there are no more than entries, rest has all, and head the costs of the most frequent of the highest order.
    """
    level, tables, whole, pruned = scratch.saved(counts, "grams"), {}, {}, False
    for order in range(ORDER, 0, -1):
        stats = level.groupBy("lang").agg(F.sum("a").alias("total"), F.sum((F.col("a") == 1).cast("long")).alias("ones"), F.sum((F.col("a") == 2).cast("long")).alias("twos"), F.count(F.lit(1)).alias("rows"))
        found = stats.collect()
        if len(found) > LANGUAGES:
            raise ValueError(f"{len(found)} languages; {LANGUAGES} at most")
        many = sum(r.rows for r in found) > entries
        pruned = pruned or many
        limits = [(r.lang, k, -(-r.total * len(found) // entries) if many else 1, min(0.95, max(0.1, r.ones / (r.ones + 2 * r.twos))) if r.ones else 0.5) for k, r in enumerate(sorted(found))]
        limits = scratch.spark.createDataFrame(limits, "lang string, k int, least long, discount double")
        totals = level.groupBy("lang", F.shiftright("key", BITS).alias("context")).agg(F.sum("a").alias("total"))
        shares = level.join(F.broadcast(limits), "lang").withColumn("context", F.shiftright("key", BITS)).join(totals, ["lang", "context"])
        whole[order] = scratch.saved(shares.select("k", "key", ((F.col("a") - F.col("discount")) / F.col("total")).alias("share"), (F.col("a") >= F.col("least")).alias("kept"), "a"), "shares")
        tables[order] = whole[order].filter("kept").drop("kept", "a").toPandas()
        names = sorted(r.lang for r in found)
        if order > 1:
            lower = level.groupBy("lang", F.col("key").bitwiseAND((1 << BITS * (order - 1)) - 1).alias("key")).agg(F.count(F.lit(1)).alias("a"))
            before, level = level, scratch.saved(lower, "grams")
            scratch.drop(before)
    parts = {o: dict(list(t.groupby("k"))) for o, t in tables.items()}
    empty = np.empty(0, np.int64), np.empty(0)
    models = Models({name: Model([(t["key"].to_numpy(), t["share"].to_numpy()) if (t := parts[o].get(k)) is not None else empty for o in range(1, ORDER + 1)]) for k, name in enumerate(names)})
    if pruned:
        often = scratch.saved(whole[ORDER].groupBy("key").agg(F.sum("a").alias("n")), "often")
        models.rest = reduce(DataFrame.unionByName, [t.select(F.lit(o).alias("order"), "k", "key", "share") for o, t in whole.items()])
        head = event_costs(frequent(often, "n", COSTS // (1 + len(names))).select("key"), models)
        head = head.select("key", *[F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(len(names))]).toPandas().sort_values("key")
        models.head = head["key"].to_numpy(np.int64), head.drop(columns="key").to_numpy(np.int64)
        scratch.drop(often)
    else:
        scratch.drop(*whole.values())
    return models


def event_costs(asked: DataFrame, models: Models) -> DataFrame:
    """(key, bits) of distinct n-grams (key) of the highest order: units of bits by language, by all n-grams of models.rest.

    N-grams are dealt to parts by the two characters before their last, all of a context to one part, and a part is a
    sorted hash array again. Single characters, 2^BITS a language at most, are broadcast; pairs are repeated in the
    parts of their first character.
    """
    n, rest = len(models), models.rest
    part = F.shiftright("key", BITS).bitwiseAND((1 << 2 * BITS) - 1).alias("part")
    single = rest.filter("order = 1").toPandas()
    single = asked.sparkSession.sparkContext.broadcast([single[single["k"] == k] for k in range(n)])

    def bits(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        key, cost = asked["key"].to_numpy(np.int64), []
        for k in range(n):
            own = held[held["k"] == k]
            levels = [single.value[k], *(own[own["order"] == o] for o in range(2, ORDER + 1))]
            cost.append(-np.log2(Model([(t["key"].to_numpy(np.int64), t["share"].to_numpy(float)) for t in levels]).probability(key)))
        return pd.DataFrame({"key": key, "bits": pd.Series(list(np.rint(np.stack(cost, axis=1) / UNIT).astype(np.int64)), dtype=object)})

    asked = asked.select("key", part)
    pairs = rest.filter("order = 2").withColumn("last", F.shiftright("key", BITS)).join(asked.select("part", F.col("part").bitwiseAND((1 << BITS) - 1).alias("last")).distinct(), "last").drop("last")
    held = rest.filter("order > 2").withColumn("part", part).unionByName(pairs)
    return asked.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(bits, "key long, bits array<long>")


class Scorer:
    """Bits that each language's model needs for the words of texts."""

    def __init__(self, models: list[Model]):
        self.models, self.known = models, {}
        self.costs = np.empty((REMEMBERED, 1 + len(models)))

    def met(self, text: int, found: list[bytes], costs: np.ndarray) -> None:
        """Takes note of a text's words and their costs."""

    def cost(self, found: list[bytes]) -> np.ndarray:
        key, place = grams(found)
        events = np.bincount(place, minlength=len(found))
        return np.stack([events, *(np.bincount(place, -np.log2(m.probability(key)), len(found)) for m in self.models)], axis=1)

    def totals(self, texts: list[str]) -> np.ndarray:
        """Characters and bits by language, of each text."""
        out, start = np.zeros((len(texts), self.costs.shape[1]), self.costs.dtype), 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= TOGETHER):
                chars += len(texts[end])
                end += 1
            cut = [words(t) for t in texts[start:end]]
            new = list(set().union(*cut).difference(self.known))
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(set().union(*cut))
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            if first + len(new) > len(self.costs):
                self.costs = np.empty((first + len(new), self.costs.shape[1]), self.costs.dtype)
            for at in range(0, len(new), 20_000):
                self.costs[first + at : first + at + 20_000][: len(new) - at] = self.cost(new[at : at + 20_000])
            find = self.known.__getitem__
            for k, w in enumerate(cut, start):
                if w:
                    own = self.costs[list(map(find, w))]
                    out[k] = own.sum(axis=0)
                    self.met(k, w, own)
            start = end
        return out


class HeadScorer(Scorer):
    """Units of bits by language for the n-grams of texts that the head has, and the others of each text."""

    def __init__(self, key: np.ndarray, bits: np.ndarray):
        # what the head lacks stands last and costs nothing here
        self.key, self.bits = key, np.vstack([bits, np.zeros((1, bits.shape[1]), np.int64)])
        self.known, self.others = {}, {}
        self.costs = np.empty((REMEMBERED, 2 + bits.shape[1]), np.int64)

    def places(self, key: np.ndarray) -> np.ndarray:
        """Where the head has n-grams, its length for others."""
        at = np.searchsorted(self.key, key)
        return np.where(np.append(self.key, -1)[at] == key, at, len(self.key))

    def cost(self, found: list[bytes]) -> np.ndarray:
        """Events, units by language, and events that the head lacks."""
        key, place = grams(found)
        at, start = self.places(key), np.r_[0, np.flatnonzero(np.diff(place)) + 1]
        return np.column_stack([np.bincount(place, minlength=len(found)), np.add.reduceat(self.bits[at], start), np.add.reduceat((at == len(self.key)).astype(np.int64), start)])

    def met(self, text: int, found: list[bytes], costs: np.ndarray) -> None:
        lacking = np.flatnonzero(costs[:, -1])
        if len(lacking):
            key = grams([found[i] for i in lacking.tolist()])[0]
            self.others[text] = np.unique(key[self.places(key) == len(self.key)], return_counts=True)


def margin_class(bits: Column) -> Column:
    return F.least(F.lit(MARGINS - 1), F.floor(8 * F.log2(1 + bits))).cast("int")


def judged(totals: np.ndarray, lettered: np.ndarray, names: list[str]) -> list[pa.Array]:
    """lang_pred, chars, bits and margin of texts by their characters and bits by language."""
    bits = np.sort(totals[:, 1:], axis=1) if names else np.zeros((len(totals), 1))
    margin = bits[:, 1] - bits[:, 0] if len(names) > 1 else bits[:, 0]
    best = totals[:, 1:].argmin(axis=1) if names else np.zeros(len(totals), int)
    pred = [names[b] if l else UNKNOWN for b, l in zip(best.tolist(), lettered)]
    return [pa.array(pred, pa.string()), *(pa.array(np.where(lettered, v, 0.0), pa.float64()) for v in (totals[:, 0], bits[:, 0], margin))]


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)


def measured(rows: DataFrame, models: Models) -> DataFrame:
    """rows (…, text) with lang_pred, chars, bits (of its model) and margin (to the next best), in place of the text; lang_pred is UNKNOWN where text is null or has no letter."""
    if getattr(models, "rest", None) is not None:
        return measured_in_parts(rows, models)
    names = sorted(models)
    shared = rows.sparkSession.sparkContext.broadcast([models[n] for n in names])
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lettered = has_letter(texts) & bool(names)
            totals = scorer.totals([t if l else "" for t, l in zip(texts, lettered)])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *judged(totals, lettered, names)], [*(f.name for f in kept), "lang_pred", "chars", "bits", "margin"])

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string, chars double, bits double, margin double"]))


def measured_in_parts(rows: DataFrame, models: Models) -> DataFrame:
    """The same by all n-grams: costs of those in models.head are broadcast, all others are asked of event_costs() once each and joined."""
    names, scratch = sorted(models), Scratch(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    shared = rows.sparkSession.sparkContext.broadcast(models.head)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, none = HeadScorer(*shared.value), (np.empty(0, np.int64),) * 2
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lettered = has_letter(texts)
            scorer.others = {}
            sums = scorer.totals([t if l else "" for t, l in zip(texts, lettered)])[:, :-1]
            others, times = zip(*[scorer.others.get(k, none) for k in range(len(texts))]) if texts else ((), ())
            arrays = [pa.array(lettered), pa.array(list(sums), pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *arrays], [*(f.name for f in kept), "lettered", "sums", "others", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = np.array(batch.column("lettered").to_pylist(), bool)
            totals = np.array(batch.column("sums").to_pylist(), float).reshape(-1, 1 + len(names))
            totals[:, 1:] *= UNIT
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *judged(totals, lettered, names)], [*(f.name for f in kept), "lang_pred", "chars", "bits", "margin"])

    # the numbers of rows hold, as the table is written
    some = scratch.saved(rows.mapInArrow(known, f"{own}, lettered boolean, sums array<long>, others array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()), "sums")
    rare = some.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("row", F.col("o.others").alias("key"), F.col("o.times").alias("n"))
    priced = rare.join(event_costs(rare.select("key").distinct(), models), "key")
    more = priced.groupBy("row").agg(F.array(F.lit(0).cast("long"), *[F.sum(F.col("n") * F.get("bits", F.lit(k))) for k in range(len(names))]).alias("more"))
    every = some.drop("others", "times").join(more, "row", "left").withColumn("sums", F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b)))
    return every.select(*[f.name for f in kept], "lettered", "sums").mapInArrow(run, f"{own}, lang_pred string, chars double, bits double, margin double")


def rising(shares: list[float], weights: list[float]) -> list[float]:
    """The nearest shares that never fall: neighbours that do are pooled."""
    pools: list[list[float]] = []
    for s, w in zip(shares, weights, strict=True):
        pools.append([s, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [s for s, _, n in pools for _ in range(int(n))]


def calibrated(rows: DataFrame) -> tuple[list[float], dict[tuple[str, int], float]]:
    """From measured rows with lang: the share of right answers by class of margin, and the ceiling of bits a character by language and power of two of the length."""
    right = {r.c: r for r in rows.groupBy(margin_class(F.col("margin")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("long")).alias("right")).collect()}
    odds = [1 / (1 + 2.0 ** -min(900.0, 2.0 ** ((c + 0.5) / 8) - 1)) for c in range(MARGINS)]
    n_of = [right[c].n if c in right else 0 for c in range(MARGINS)]
    share = [((right[c].right if c in right else 0) + PRIOR * odds[c]) / (n_of[c] + PRIOR) for c in range(MARGINS)]
    per_char = F.col("bits") / F.col("chars")
    own = rows.filter("lang = lang_pred AND chars > 0").groupBy("lang", F.floor(F.log2("chars")).cast("int").alias("size"))
    sums = {(r.lang, r.size): np.array(r[2:], float) for r in own.agg(F.count(F.lit(1)), F.sum(per_char), F.sum(per_char * per_char)).collect()}
    ceilings = {}
    for (lang, size), own in sums.items():
        wider = sum(v for (other, _), v in sums.items() if other == lang)
        for key, (n, mean, square) in (((lang, size), own + BORROWED * wider / wider[0]), ((lang, ANY), wider)):
            ceilings[key] = float(mean / n + DEVIATIONS * max(0.0, square / n - (mean / n) ** 2) ** 0.5)
    return rising(share, [k + PRIOR for k in n_of]), ceilings


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", entries: int = ENTRIES) -> tuple:
    """(models, shares of right answers, ceilings) from all rows with a text and a language that aren't held out; one in CALIBRATED texts is for calibration, equal texts alike."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    own = F.pmod(F.xxhash64("text"), F.lit(CALIBRATED)) == 0
    models = learned(gram_counts(word_counts(rows.filter(~own))), scratch, entries)
    return models, *calibrated(scratch.saved(measured(rows.filter(own), models).filter(F.col("lang_pred") != UNKNOWN), "calibration"))


def identify(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, accepted, bits_per_char.

    lang_pred is the language whose model needs the fewest bits for a character of the whole text, ties to the first
    name; score the share of right answers that calibration found at such a margin to the next best, made to rise with
    it. A text is accepted if its score is least_score or more and its bits a character don't exceed the ceiling of its
    language and length, or of its language where calibration saw no such length. Texts that are null or have no letter, and all texts if no language was learned, are
    UNKNOWN with a score of 0, and not accepted. Repeated rows each get a row; rows without an id count as not held
    out. An empty table gives an empty table.
    """
    models, shares, ceilings = model
    spark = docs.sparkSession
    rows = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), models)
    score = F.when(F.col("lang_pred") != UNKNOWN, F.element_at(F.array(*map(F.lit, shares)), margin_class(F.col("margin")) + 1)).otherwise(F.lit(0.0))
    limits = F.broadcast(spark.createDataFrame([(*k, v) for k, v in ceilings.items()], "lang_pred string, size int, most double"))
    sized = rows.withColumns({"score": score, "bits_per_char": F.col("bits") / F.nullif("chars", F.lit(0.0)), "size": F.coalesce(F.floor(F.log2(F.nullif("chars", F.lit(0.0)))).cast("int"), F.lit(ANY))})
    # a row for each language and length: at most LANGUAGES times the powers of two
    met = sized.join(limits, ["lang_pred", "size"], "left").join(limits.filter(F.col("size") == ANY).select("lang_pred", F.col("most").alias("any")), "lang_pred", "left")
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score) & F.coalesce(F.col("bits_per_char") <= F.coalesce("most", "any"), F.lit(True))
    return met.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", accepted.alias("accepted"), "bits_per_char")
