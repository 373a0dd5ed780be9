"""Near copies by the exact Jaccard similarity of their shingles, found in an index of rarest shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import simhash
from memlake.llm.components import components
from memlake.llm.lists import runs, whole_lists
from memlake.llm.tables import Scratch, packed, small_batches, unpacked

#: Words to a shingle.
WORDS = 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
#: About so many texts tell which shingles are common; that decides the order of the index, never a link.
ORDERED_BY = 20_000
#: Index lists longer than this are worked off as a whole, with their texts' shingles, and not pair by pair.
LONG_LIST = 64
#: Bins that bound how many shingles two texts can share before their sets are sent.
BINS = 128


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; a text with fewer words is one shingle, without words an empty one."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()
    parts = map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False)) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, simhash.SEED) for s in parts]), ">u8").astype(np.uint64).view(np.int64))


#: Bytes of a shingle's hash in a set that is sent.
WIDTH = 6


def packed_set(found: np.ndarray) -> bytes:
    """The distinct lowest WIDTH bytes of hashes, in order: two of a text's shingles are taken for one about once in a billion texts."""
    cut = np.unique(found.view(np.uint64) & np.uint64(2 ** (8 * WIDTH) - 1))
    return cut.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return wide.reshape(-1).view("<i8")


def shingle_sets(text: Column, words: int = WORDS) -> Column:
    """The packed sets of texts."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([packed_set(shingles(t, words)) for t in texts], dtype=object)

    return of(text)


def shared(a: Column, b: Column) -> Column:
    """How many shingles two packed sets have in common."""

    @F.pandas_udf("long")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(unpacked_set(x), unpacked_set(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    return of(a, b)


def size_of(packed: Column) -> Column:
    return (F.octet_length(packed) / WIDTH).cast("long")


def bin_counts(sets: Column) -> Column:
    """How many shingles of a set end in each of BINS values, a byte each (255 for more)."""

    @F.pandas_udf("binary")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([np.minimum(np.bincount(unpacked_set(x) & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes() for x in column], dtype=object)

    return of(sets)


def most_alike(a: Column, b: Column, m: Column, n: Column) -> Column:
    """The most that a similarity can be by bin counts a and b of m and n shingles, as shared shingles over both numbers."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, BINS) for c in (a, b))
        full = ((x == 255) & (y == 255)).any(axis=1)
        sizes = (m + n).to_numpy()
        return pd.Series(np.where(full, np.minimum(m, n), np.minimum(x, y).sum(axis=1, dtype=np.int64)) / np.maximum(sizes, 1))

    return of(a, b, m, n)


def common_shingles(texts: DataFrame, words: int, ordered_by: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ordered_by texts have, sorted, and in how many they are."""
    every = max(1, texts.count() // ordered_by)

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"s": np.concatenate([np.empty(0, np.int64), *(shingles(t, words) for t in batch["text"])])})

    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text").mapInPandas(exploded, "s long")
    counts = some.groupBy("s").count().filter("count >= 4").toPandas().sort_values("s")
    return counts["s"].to_numpy(np.int64), counts["count"].to_numpy(np.int64)


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """So many of the rarest shingles that two texts of the least similarity share one: n - ceil(least * n) + 1 of n."""
    names, counts = common
    rank = np.zeros(len(found), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, found), len(names) - 1)
        rank = np.where(names[at] == found, counts[at], 0)
    p, q = least
    return found[np.lexsort((found, rank))[: len(found) + (-p * len(found)) // q + 1]]


def linked_in_list(sets: list[np.ndarray], tied: np.ndarray | None = None, least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """A forest over the links between the sets of one list: what a set links to isn't compared with it again, nor are sets of equal tied."""
    p, q = least
    sizes = np.array([len(x) for x in sets])
    tied = np.arange(len(sets)) if tied is None else tied
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(int(flat.max()) + 1, bool)
    links, open_, queue = [], np.arange(1, len(sets)), [0]
    while len(open_):
        if not queue:
            queue, open_ = [int(open_[0])], open_[1:]
            continue
        i = queue.pop()
        known = tied[open_] == tied[i]
        queue += open_[known].tolist()
        open_ = open_[~known]
        tried = open_[(q * sizes[open_] >= p * sizes[i]) & (q * sizes[i] >= p * sizes[open_])]
        if not len(tried):
            continue
        mine = flat[bounds[i] : bounds[i + 1]]
        mark[mine] = True
        first = np.r_[0, np.cumsum(sizes[tried])[:-1]]
        where = np.repeat(bounds[tried] - first, sizes[tried]) + np.arange(sizes[tried].sum())
        shared = np.add.reduceat(mark[flat[where]].astype(np.int64), first)
        mark[mine] = False
        reached = tried[(p + q) * shared >= p * (sizes[tried] + sizes[i])]
        links += [(i, j) for j in reached.tolist()]
        queue += reached.tolist()
        open_ = np.setdiff1d(open_, reached, assume_unique=True)
    return links


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST, long_list: int = LONG_LIST, ordered_by: int = ORDERED_BY) -> DataFrame:
    """Links (a, b) between ids that tie together all rows whose texts have at least the least Jaccard similarity.

    For each text its likeliest partner in the index is compared first, in all their shingles. What these tie together
    isn't compared again. No link is lost: two texts of the least similarity share one of the
    rarest shingles of either (prefix filtering), so both stand in one index list; pairs of short lists are compared
    where bin counts don't rule them out, long lists as a whole. Rows without an id have no links.
    """
    p, q = least
    scratch = Scratch(docs.sparkSession)
    texts = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("node"), docs[text_col].alias("text"))
    common = common_shingles(texts, words, ordered_by)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            keys = [prefix(x, common, least) for x in sets]
            many = [len(k) for k in keys]
            yield pd.DataFrame({"s": np.concatenate([np.empty(0, np.int64), *keys]), "node": np.repeat(batch["node"].to_numpy(np.int64), many), "n": np.repeat(np.array([len(x) for x in sets], np.int32), many)})

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_lists(batches, ["s"]):
            s, node, n = batch["s"].to_numpy(), batch["node"].to_numpy(), batch["n"].to_numpy().astype(np.int64)
            a, b, hot = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in runs(s):
                if j - i > long_list:
                    hot.append(np.arange(i, j))
                    continue
                x, y = np.triu_indices(j - i, 1)
                able = (q * np.minimum(n[i + x], n[i + y]) >= p * np.maximum(n[i + x], n[i + y])) & (node[i + x] != node[i + y])
                a.append(np.minimum(node[i + x], node[i + y])[able])
                b.append(np.maximum(node[i + x], node[i + y])[able])
            pairs = pd.DataFrame({"s": None, "a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
            whole = np.concatenate(hot)
            yield pd.DataFrame({"s": pd.array([None] * len(pairs), "Int64"), "a": pairs["a"].to_numpy(), "b": pd.array(pairs["b"], "Int64")})
            yield pd.DataFrame({"s": pd.array(s[whole], "Int64"), "a": node[whole], "b": pd.array([None] * len(whole), "Int64")})

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_lists(batches, ["s"]):
            s, node, tied, sets = batch["s"].to_numpy(), batch["node"].to_numpy(), batch["component"].to_numpy(), [unpacked_set(x) for x in batch["x"]]
            for i, j in runs(s):
                pairs = np.array(linked_in_list(sets[i:j], tied[i:j], least), np.int64).reshape(-1, 2) + i
                yield pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    index = texts.mapInPandas(indexed, "s long, node long, n int").repartition("s").sortWithinPartitions("s")
    found = scratch.saved(index.mapInPandas(candidates, "s long, a long, b long"), "candidates")
    pairs = scratch.saved(found.filter("s IS NULL").select("a", "b").distinct(), "pairs")
    hot = scratch.saved(found.filter("s IS NOT NULL").select("s", F.col("a").alias("node")), "hot")
    scratch.drop(found)

    ends = lambda links: links.select(F.explode(F.array("a", "b")).alias("node"))
    needed = scratch.saved(ends(pairs).union(hot.select("node")).distinct(), "needed")
    rows = texts.join(needed.hint("merge"), "node", "left_semi")
    if not texts.groupBy("node").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["node", "text"])
    sets = scratch.saved(rows.select("node", shingle_sets(F.col("text"), words).alias("x")), "shingles")
    bins = scratch.saved(sets.select("node", size_of(F.col("x")).alias("n"), bin_counts(F.col("x")).alias("h")), "bins")
    sides = [bins.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("h").alias(f"h{c}")) for c in "ab"]
    able = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("most", most_alike(F.col("ha"), F.col("hb"), F.col("na"), F.col("nb")))
    close = scratch.saved(able.filter(F.col("most") * (p + q) >= p * (1 - 1e-12)).select("a", "b", "most"), "close")
    scratch.drop(pairs, bins, needed)

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of pairs that are links. Sets that no pair needs stay where they are."""
        pairs = scratch.saved(pairs, "asked")
        needed = scratch.saved(ends(pairs).distinct(), "needed")
        x, y = (sets.join(needed.hint("merge"), "node", "left_semi").select(F.col("node").alias(c), F.col("x").alias(f"x{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").withColumn("shared", shared(F.col("xa"), F.col("xb")))
        links = scratch.saved(both.filter((p + q) * F.col("shared") >= p * (size_of(F.col("xa")) + size_of(F.col("xb")))).select("a", "b"), "links")
        scratch.drop(pairs, needed)
        return links

    likeliest = close.groupBy("b").agg(F.max_by("a", F.struct("most", -F.col("a"))).alias("a")).select("a", "b")
    first = alike(likeliest)
    tied = scratch.saved(components(first), "tied")
    side = lambda c: tied.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = close.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    second = alike(apart)
    listed = hot.join(tied, "node", "left").select("s", "node", F.coalesce("component", "node").alias("component"))
    several = listed.groupBy("s").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("s")
    split = scratch.saved(listed.join(several, "s", "left_semi"), "split")
    mine = sets.join(split.select("node").distinct(), "node", "left_semi")
    in_lists = split.join(mine, "node").select("s", "node", "component", "x").repartition("s").sortWithinPartitions("s")
    third = scratch.saved(in_lists.mapInPandas(linked, "a long, b long"), "links")
    scratch.drop(sets, close, tied, hot, split)
    return first.unionByName(second).unionByName(third)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Callable[[DataFrame, str, str], DataFrame] | None = None, **options) -> DataFrame:
    """The rows of docs whose id is the smallest of those they are tied to by links, and those without an id, with all their columns.

    Links and their edge cases are those of similar_links(): null and empty texts are alike, rows that repeat an id stay
    or go together, and an empty table gives an empty table. also(docs, id_col, text_col) gives further links (a, b).
    """
    with small_batches(docs.sparkSession):
        more = also(docs, id_col, text_col) if also else None
        links = similar_links(docs, id_col, text_col, **options)
    links = links.unionByName(more) if also else links
    gone = components(links).select(F.col("node").alias("gone"))
    rows = packed(docs, id=docs[id_col].cast("long"))
    return unpacked(rows.join(gone, rows["id"] == gone["gone"], "left_anti"), docs.columns)
