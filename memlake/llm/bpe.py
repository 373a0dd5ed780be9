"""Byte-level BPE by a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded pre-tokens that a Python worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Texts are encoded together up to about so many characters: what none of them had before goes through the queue at once.
TOGETHER = 1_000_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


#: Bits of a word in the rank queue's bitmap. Python's integers are as wide as asked for, so two levels span 65,536 ranks.
WIDTH = 8


class Encoder:
    """Encodes and decodes by a vocabulary; known: pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        words = (max(ranks.values(), default=0) >> WIDTH) + 1
        self.words, self.bits = [0] * words, [1 << n for n in range(max(words, 1 << WIDTH))]
        #: Ranks of pairs of single bytes, by the first and the second.
        self.first = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])
        self.packed = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.tokens = {r: t for t, r in ranks.items()}
        self.known: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= TOGETHER):
                chars += len(texts[end])
                end += 1
            cut = [self.split(t) for t in texts[start:end]]
            new = set().union(*cut).difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*cut)
            pieces = [w.encode("utf-8", "surrogatepass") for w in new]
            whole = list(map(self.packed.get, pieces))
            merged = iter(self.merged([p for p, w in zip(pieces, whole, strict=True) if w is None]))
            self.known.update(zip(new, [w or next(merged) for w in whole], strict=True))
            find = self.known.__getitem__
            out += [b"".join(map(find, c)) for c in cut]
            for w in new:
                if len(w) > REMEMBERED_CHARS:
                    del self.known[w]
            start = end
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Merges, in each piece, the adjacent pair of least rank, the leftmost of equals, until no pair has one.

        All pieces are one linked list of parts, with no pairs across their ends. Each rank has a bucket of the
        positions where its pair begins. A bitmap of two levels tells which buckets hold any, and its lowest set bits
        give the next rank. Entries of pairs that are gone stay in their buckets and are skipped. A merge that makes a
        pair of lower rank has that one done before what is left of its bucket. The bitmap ends up empty again.
        """
        data, get, words, bits, top = b"".join(pieces), self.ranks.get, self.words, self.bits, 0
        n = len(data)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        codes = np.frombuffer(data, np.uint8).astype(np.int64)
        ranks = np.append(self.first[codes[:-1] << 8 | codes[1:]], -1) if n else np.empty(0, np.int64)
        ranks[ends - 1] = -1
        previous = np.arange(-1, n - 1)
        previous[ends - lengths] = -1
        pair, before, after, limit = ranks.tolist(), previous.tolist(), list(range(1, n + 1)), np.repeat(ends, lengths).tolist()
        after.append(n)
        buckets: dict[int, list[int]] = {}
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cuts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]) if len(order) else ():
            rank = pair[order[s]]
            buckets[rank] = order[s:e].tolist()
            words[rank >> WIDTH] |= bits[rank & 255]
            top |= bits[rank >> WIDTH]
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = (high << WIDTH) + low.bit_length() - 1
            words[high] = word = word ^ low
            if not word:
                top ^= bits[high]
            bucket = buckets.pop(rank)
            bucket.sort()
            for place, i in enumerate(bucket):
                if pair[i] != rank:
                    continue
                j = after[i]
                after[i] = k = after[j]
                pair[j] = -1
                least = rank
                if k < limit[i]:
                    before[k] = i
                    pair[i] = now = get(data[i : after[k]], -1)
                    if now >= 0:
                        if now in buckets:
                            buckets[now].append(i)
                        else:
                            buckets[now] = [i]
                            words[now >> WIDTH] |= bits[now & 255]
                            top |= bits[now >> WIDTH]
                        least = now
                else:
                    pair[i] = -1
                at = before[i]
                if at >= 0:
                    now = get(data[at:k], -1)
                    if now != pair[at]:
                        pair[at] = now
                        if now >= 0:
                            if now in buckets:
                                buckets[now].append(at)
                            else:
                                buckets[now] = [at]
                                words[now >> WIDTH] |= bits[now & 255]
                                top |= bits[now >> WIDTH]
                            if now < least:
                                least = now
                if least < rank:
                    rest = bucket[place + 1 :]
                    if rest:
                        buckets[rank] = buckets.get(rank, []) + rest
                        words[rank >> WIDTH] |= bits[rank & 255]
                        top |= bits[rank >> WIDTH]
                    break
        out, packed, i = [], self.packed, 0
        for end in ends.tolist():
            ids = []
            while i < end:
                j = after[i]
                ids.append(packed[data[i:j]])
                i = j
            out.append(b"".join(ids))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder(parse_ranks(raw), pattern)


def _shipped(df: DataFrame, path: str | None):
    """The vocabulary file, read by the driver; its size doesn't grow with the data."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id_col and ids (array of int) for every row, in the order of docs.

    path names a file of "base64 rank" lines, by default the 50k byte-level vocabulary. Each match of pattern is
    encoded by itself; special tokens are ordinary text. Null and empty texts have no ids. Repeated rows and null ids
    come out as they are; an empty table gives an empty table.
    """
    raw = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(raw.value, pattern)
        for batch in batches:
            packed = tool.encode_all([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def _decoded_columns(tool: Encoder, column: pa.ListArray) -> tuple[list[int], list[str], list[bytes]]:
    counts, digests, decoded = [], [], []
    for row in column:
        ids = np.empty(0, np.int32) if row.values is None else row.values.to_numpy(zero_copy_only=False)
        counts.append(len(ids))
        digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
        decoded.append(tool.decode(ids.tolist()))
    return counts, digests, decoded


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded (bytes) of every row of encode_texts().

    Null and empty texts have no ids: a count of 0, the digest of nothing, and no bytes. Repeated rows, and rows without an
    id, each get a row. An empty table gives an empty table; other columns aren't read.
    """
    raw = _shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(raw.value, pattern)
        for batch in batches:
            counts, digests, decoded = _decoded_columns(tool, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.binary())], ["id", "n_tokens", "ids_sha256", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded binary").withColumnRenamed("id", id_col)


def with_digests(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id_col, ids, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to) of every row of encode_texts().

    Null and empty texts have an empty list and the digests of nothing. Repeated rows, and rows without an id, each get a
    row. An empty table gives an empty table; other columns aren't read.
    """
    raw = _shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(raw.value, pattern)
        for batch in batches:
            counts, digests, decoded = _decoded_columns(tool, batch.column(1))
            texts = [hashlib.sha256(d).hexdigest() for d in decoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
