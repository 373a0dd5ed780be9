"""SimHash near-duplicates, found in a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.components import components
from memlake.llm.lists import runs, whole_lists
from memlake.llm.tables import Scratch, join_to_groups, packed, unpacked

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BYTES = 8
#: Fingerprints that differ in MAX_BITS bits share the bytes of at least so many positions.
MIN_SHARED = BYTES - MAX_BITS
#: Index lists longer than this are split by two more positions.
LONG_LIST = 2048
#: Lists longer than this, of fingerprints that agree in MIN_SHARED bytes, are searched by flipping their other bits.
DENSE_LIST = 50_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = np.arange(BYTES, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, BYTES)
    seen = np.bincount((hashes + _OFFSETS).ravel(), minlength=256 * BYTES).reshape(BYTES, 256)
    return int(np.packbits(2 * (seen @ _BITS).ravel() > len(hashes)).view(">i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Words lose the capitals of A-Z and are parted by ASCII white space; shingle in a row, repeats included, make one."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _mask(positions: tuple[int, ...]) -> int:
    whole = sum(0xFF << 8 * (BYTES - 1 - p) for p in positions)
    return whole - (1 << 64) if whole >> 63 else whole


#: Of the MIN_SHARED positions that two linked fingerprints share, three lie in one half: eight keys reach every link.
SHORT_KEYS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
#: The same positions with every choice of two more: still every link, in far shorter lists.
LONG_KEYS = list(combinations(range(BYTES), MIN_SHARED))


def _indexed(nodes: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("c"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for n, p in enumerate(keys)])
    return nodes.select("fp", "node", F.explode(entries).alias("e")).select("e.c", "e.key", "fp", "node")


def spanning_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """A forest over the links between the distinct fingerprints of one list.

    The list has an index of its own, of the entries with each byte at each position. The postings of a fingerprint's
    bytes are tallied; those met at MIN_SHARED positions or more, the least for any link, are verified bit by bit.
    """
    n = len(fp)
    at = fp.view(np.uint8).reshape(n, BYTES)
    same = [c for c in range(BYTES) if (at[:, c] == at[0, c]).all()]
    postings = [(at[:, c], np.argsort(at[:, c], kind="stable"), np.r_[0, np.cumsum(np.bincount(at[:, c], minlength=256))]) for c in range(BYTES) if c not in same]
    found, todo, queue = [], np.ones(n, bool), [0]
    todo[0] = False
    while queue or todo.any():
        if not queue:
            queue = [int(todo.argmax())]
            todo[queue[0]] = False
        i = queue.pop()
        tally = np.full(n, len(same))
        for byte, order, bounds in postings:
            tally[order[bounds[byte[i]] : bounds[byte[i] + 1]]] += 1
        met = np.flatnonzero(todo & (tally >= MIN_SHARED))
        reached = met[np.bitwise_count(fp[met] ^ fp[i]) <= MAX_BITS]
        todo[reached] = False
        found += [(i, j) for j in reached.tolist()]
        queue += reached.tolist()
    return found


def flipped_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """The same for a long list, of which MIN_SHARED bytes agree: every choice of up to MAX_BITS of the other bits is looked up flipped."""
    differing = int(np.bitwise_or.reduce(fp ^ fp[0]))
    free = [1 << b for b in range(64) if differing >> b & 1]
    order = np.argsort(fp)
    value, root = fp[order], np.arange(len(fp))
    for bits in range(1, MAX_BITS + 1):
        for chosen in combinations(free, bits):
            other = value ^ np.uint64(sum(chosen))
            place = np.minimum(np.searchsorted(value, other), len(value) - 1)
            a = np.flatnonzero(value[place] == other)
            b = place[a]
            while (root[a] != root[b]).any():
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
    tied = np.flatnonzero(root != np.arange(len(root)))
    return list(zip(order[root[tied]].tolist(), order[tied].tolist(), strict=True))


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in whole_lists(batches, ["c", "key"]):
        fp, node = batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy()
        a, b = [], []
        for s, e in runs(batch["c"].to_numpy(), batch["key"].to_numpy()):
            for i, j in (flipped_links if e - s > DENSE_LIST else spanning_links)(fp[s:e]):
                a.append(node[s + i])
                b.append(node[s + j])
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def fingerprint_links(nodes: DataFrame, long_list: int = LONG_LIST, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) that tie together the nodes (fp, node) of distinct fingerprints at MAX_BITS or fewer differing bits.

    Not every pair comes out, but every pair is joined by a path of links. The index has lists by the bytes at three
    positions, as a single byte's list would hold a 256th of all. Of MIN_SHARED shared positions three lie in one half,
    so that eight lists of each fingerprint reach every link; within a list shared bytes are counted by position. A
    list is one task's work; lists over long_list entries are indexed again by MIN_SHARED positions, which leave 24 bits
    and so 2^24 fingerprints at most.
    """
    scratch = scratch or Scratch(nodes.sparkSession)
    index = _indexed(nodes, SHORT_KEYS)
    sizes = index.groupBy("c", "key").count().filter("count > 1")
    shared = scratch.saved(index.join(sizes, ["c", "key"]), "index")
    short = shared.filter(F.col("count") <= long_list).drop("count")
    hot = shared.filter(F.col("count") > long_list).select("fp", "node").distinct()
    finer = _indexed(hot, LONG_KEYS).withColumn("c", F.col("c") + len(SHORT_KEYS))
    lists = short.unionByName(finer).repartition("c", "key").sortWithinPartitions("c", "key")
    links = scratch.saved(lists.mapInPandas(_linked, "a long, b long"), "links")
    scratch.drop(shared)
    return links


def text_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) that tie together the ids of rows whose fingerprints differ in MAX_BITS or fewer bits; rows without an id have none."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("node"), fingerprints(docs[text_col]).alias("fp"))
    prints = scratch.saved(rows, "fingerprints")
    nodes = scratch.saved(prints.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    between = fingerprint_links(nodes.select("fp", "node"), scratch=scratch)
    within = join_to_groups(prints, nodes.select("fp", F.col("node").alias("a"), "n"), "fp", "n", "node").select("a", F.col("node").alias("b")).filter("a <> b")
    links = scratch.saved(between.unionByName(within), "links")
    scratch.drop(prints, nodes, between)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat an id or text link as such.
    Null ids name no component: theirs is the smallest id among the others, or null. Ids are whole numbers, or text that
    reads as such. An empty table gives an empty table; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.saved(docs.select(F.col(id_col).cast("long").alias("id"), fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    named = scratch.saved(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    links = fingerprint_links(named.filter("node IS NOT NULL").select("fp", "node"), long_list, scratch)
    found = components(links)
    classes = scratch.saved(named.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n"), "classes")
    scratch.drop(named, links)
    rows = join_to_groups(prints, classes, "fp", "n", "id")
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component, and those without an id, with all their columns.

    Components and edge cases are those of near_duplicates(); rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    rows = packed(docs, id=docs[id_col].cast("long"))
    return unpacked(rows.join(gone, rows["id"] == gone["gone"], "left_anti"), docs.columns)
