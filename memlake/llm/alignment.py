"""Alignment of two tokenizers' tokens by the byte offsets where both end, and counts of the ids that they link."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import Scratch, frequent

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments between spaces whose pieces a Python worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Segments that are encoded as one text.
TOGETHER = 2_000
#: Ends that are compared one by one.
LOCAL = 8
#: Groups with more links than this have their ids counted before they are paired.
DENSE = 4_096
#: Pairs of ids that a task holds before it adds them up, and sums before it hands them on.
HELD = 2_000_000
#: The most frequent pairs of ids whose counts every worker holds: they bound what is broadcast.
HEAD_PAIRS = 500_000
#: A pair of ids is one number: this times the first, and the second.
SPAN = 1 << 20


class ByteTokens:
    """Ids of a byte-level BPE file of the tokenizers library.

    Ids of such a file follow the order of its merges, so that it merges as ranks do; that is checked for each merge.
    """

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        if model["normalizer"] or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} isn't plain byte-level BPE")
        special = {t["content"] for t in model["added_tokens"]}
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        merged = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])]
        if any(b <= a for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(vocab):
            raise ValueError(f"the ids of {path} don't follow its merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("byte tokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)

    def encode(self, text: str) -> np.ndarray | None:
        """The ids, or None if they don't make up text; what they hold of it stands in its order, so that lengths tell."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return ids if self.lengths[ids].sum() == len(text.encode("utf-8", "surrogatepass")) else None


class Pieces:
    """Ids of a sentencepiece model whose text isn't normalised, and whose pieces hold spaces at their beginning only and no line ends.

    Merges then never cross from a character to a space, or a line end, so that each run of spaces, or line end, with
    what follows it is encoded by itself, and remembered. Both properties are checked; without them whole texts are
    encoded.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        apart = not any(re.search("[^▁]▁|\n", p) for p in pieces) and self.model.decode(self.model.encode(" ﬁ  x \n")) == " ﬁ  x \n"
        self.apart = apart
        self.cut = re.compile(" +[^ \n]*|\n[^ \n]*" if apart else "(?s:.+)").findall
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.space = self.model.piece_to_id("▁")
        #: Segment -> its ids as 64-bit integers, or None if their bytes aren't those of the segment.
        self.known: dict[str, bytes | None] = {}

    def _encoded(self, segments: list[str]) -> dict[str, bytes | None]:
        """The packed ids of each segment, or None; many are encoded as one text and cut apart by the lengths of their ids."""
        plain = [s.encode("utf-8", "surrogatepass") for s in segments]
        ids = np.array(self.model.encode("x" + "".join(segments), num_threads=1)[1:] if self.apart else [], np.int64)
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum(list(map(len, plain)))
        cuts = np.searchsorted(ends, wanted)
        if len(ids) and cuts[-1] < len(ends) and (ends[cuts] == wanted).all() and b"".join(map(self.bytes.__getitem__, ids.tolist())) == b"".join(plain):
            packed, cuts = ids.tobytes(), (8 * (cuts + 1)).tolist()
            return {s: packed[a:b] for s, a, b in zip(segments, [0, *cuts], cuts)}
        return dict(zip(segments, map(self._alone, segments, plain)))

    def _alone(self, segment: str, plain: bytes) -> bytes | None:
        # the library puts a space before a text by itself, but not before none; none belongs before a line end
        ids = self.model.encode(segment.removeprefix(" "), num_threads=1) or [self.space]
        ids = ids if segment[0] == " " else ids[1:]
        return np.array(ids, np.int64).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == plain else None

    def encode_all(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text, or None if their bytes aren't those of a space and the text."""
        cut = [self.cut(" " + t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        more = {s: ids for at in range(0, len(new), TOGETHER) for s, ids in self._encoded(new[at : at + TOGETHER]).items()}
        get, out = self.known.get, []
        for segments in cut:
            found = [more[s] if (ids := get(s, b"")) == b"" else ids for s in segments]
            out.append(None if None in found else np.frombuffer(b"".join(found), np.int64))
        # those that come first are the likeliest to come again
        self.known.update(islice(((s, ids) for s, ids in more.items() if len(s) <= REMEMBERED_CHARS), max(0, REMEMBERED - len(self.known))))
        return out


def inner(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Of two rising lists of ends whose last are equal, the places whose ends the other list lacks: all others end a group.

    At the current shift between the two, slices of doubling length are compared: equal ones are stretches of groups of
    one token each, jumped together. A slice that differs is halved down to LOCAL ends, which are met one by one, as are
    those of the irregular group after them, which gives the new shift.
    """
    i = j = 0
    inner_a, inner_b = [], []
    while True:
        step = LOCAL
        while (x := a[i : i + step]) == b[j : j + step]:
            if not x:
                return inner_a, inner_b
            i, j, step = i + step, j + step, 2 * step
        while step > LOCAL:
            step //= 2
            if a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        while (end := a[i]) == (other := b[j]):
            i += 1
            j += 1
        while end != other:
            if end < other:
                inner_a.append(i)
                i += 1
                end = a[i]
            else:
                inner_b.append(j)
                j += 1
                other = b[j]
        i += 1
        j += 1


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the groups that common ends cut the tokens into, as counts of tokens of each side."""
    return tuple(np.delete(np.arange(1, len(ends) + 1), gone) for ends, gone in zip((a, b), inner(a.tolist(), b.tolist())))


def links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of ids whose tokens share a group, and how many pairs of tokens each stands for."""
    starts_a, starts_b = np.r_[0, ends_a[:-1]], np.r_[0, ends_b[:-1]]
    wide, size = ends_b - starts_b, (ends_a - starts_a) * (ends_b - starts_b)
    thin = size <= DENSE
    total = np.where(thin, size, 0)
    group = np.repeat(np.arange(len(size)), total)
    at = np.arange(len(group)) - np.repeat(np.cumsum(total) - total, total)
    keys, counts = np.unique(a[starts_a[group] + at // wide[group]] * SPAN + b[starts_b[group] + at % wide[group]], return_counts=True)
    for g in np.flatnonzero(~thin).tolist():
        ids_a, n_a = np.unique(a[starts_a[g] : ends_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[starts_b[g] : ends_b[g]], return_counts=True)
        keys = np.concatenate([keys, (ids_a[:, None] * SPAN + ids_b).ravel()])
        counts = np.concatenate([counts, (n_a[:, None] * n_b).ravel()])
    if not thin.all():
        keys, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place, counts).astype(np.int64)
    return keys, counts


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), Pieces(path_b)
        if self.b.size > SPAN:
            raise ValueError(f"{path_b} has more than {SPAN} pieces")
        sides = [(range(self.a.size), ",|"), (range(self.b.size), ",;")]
        self.written = np.array([f"{i}{sign}" for ids, signs in sides for sign in signs for i in ids], object)

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text, ids of both sides and the ends of their groups; all empty for texts without tokens."""
        none = np.empty(0, np.int64)
        for text, b in zip(texts, self.b.encode_all([t or "" for t in texts])):
            a = self.a.encode(" " + text) if text and b is not None else None
            yield (none,) * 4 if a is None else (a, b, *groups(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])))

    def text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """The groups as "a1,a2|b1;a3|b2,b3"."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[ends_a - 1] = last_b[ends_b - 1] = True
        names = np.concatenate([a + self.a.size * last_a, 2 * self.a.size + b + self.b.size * last_b])
        sizes = (np.diff(ends, prepend=0) for ends in (ends_a, ends_b))
        order = np.concatenate([2 * np.repeat(np.arange(len(ends_a)), n) + side for side, n in enumerate(sizes)]).argsort(kind="stable")
        return "".join(self.written[names[order]].tolist())[:-1]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(path_a, path_b)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([*arrays, []]).astype(np.int64), kind))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, written: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, groups_sha256, and lists a, b, n: each linked pair of ids and its number of links.

    A space and the text are encoded by the byte-level BPE file path_a, the text by the sentencepiece model path_b. Null
    and empty texts, and those that either doesn't give back byte by byte, have no tokens, empty lists and an empty
    digest. With written, groups holds the groups in full, as "a1,a2|b1;a3|b2,b3". Repeated rows each get a row; whole
    texts are aligned, of any length. An empty table gives an empty table.
    """
    paths = path_a or public_tokenizers.path(BYTE_BPE), path_b or public_tokenizers.path(PIECES)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(*paths)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                counts, digests, texts, pairs = [], [], [], []
                for a, b, ends_a, ends_b in tool.align_all(batch.column("text").to_pylist()):
                    keys, n = links(a, b, ends_a, ends_b)
                    text = tool.text(a, b, ends_a, ends_b)
                    counts.append((len(a), len(b), len(ends_a), int(n.sum())))
                    digests.append(hashlib.sha256(text.encode()).hexdigest() if len(a) else "")
                    texts.append(text if written else None)
                    pairs.append((keys // SPAN, keys % SPAN, n))
                lists = [_lists(list(side), kind) for side, kind in zip(zip(*pairs), (pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digests), pa.array(texts, pa.string()), *lists], NAMES)

    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, a array<int>, b array<int>, n array<long>")
    found = found.withColumnRenamed("id", id_col)
    return found if written else found.drop("groups")


NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "a", "b", "n"]


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
    return a * SPAN + b


def pair_counts(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, docs, best) of each pair of ids in the lists of aligned(): how many rows hold it, and whether no pair of its first id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, new, n = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            distinct, place = np.unique(np.concatenate([keys, *new]), return_inverse=True)
            return distinct, np.bincount(place, np.concatenate([counts, np.ones(n)])).astype(np.int64)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "docs"])

        for batch in batches:
            new.append(_keys(batch))
            n += len(new[-1])
            if n > HELD:
                keys, counts = added()
                new, n = [], 0
                if len(keys) > HELD:
                    yield table()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = added()
        yield table()

    counts = scratch.saved(found.select("a", "b").mapInArrow(run, "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs")), "pairs")
    # one row for each id of the first vocabulary, so that its size bounds what is broadcast
    first = F.shiftright("key", SPAN.bit_length() - 1)
    most = counts.groupBy(first.alias("first")).agg(F.max("docs").alias("most"))
    return scratch.saved(counts.join(F.broadcast(most), first == F.col("first")).select("key", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")


def cross_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The counts are those of aligned(). A pair of ids counts the rows of docs that link it; n_best tells how many links
    have a pair that no other of its first id exceeds, ties included; count_sum adds the counts of all links. Rows
    without tokens have zeros and an empty digest. Repeated rows each count. The counts of the head_pairs most frequent
    pairs go to every task; rows meet all others by a join, whose keys are rare ones.
    """
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    rows = scratch.saved(aligned(docs, id_col, text_col, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, scratch)
    head = frequent(counts, "docs", head_pairs).toPandas().sort_values("key")
    shared = spark.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("key", "docs", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs_of, best = shared.value
        for batch in batches:
            keys, n = _keys(batch), batch.column("n").flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column("a").offsets.to_numpy())
            place = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            ends = np.cumsum(sizes)
            sums = []
            for values in (best, docs_of):
                added = np.zeros(len(keys) + 1, np.int64)
                added[1:][found] = n[found] * values[at[found]]
                added = np.cumsum(added)
                sums.append(added[ends] - added[ends - sizes])
            row = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, sums), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64())], PARTS)
            rest = row[place[~found]]
            yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(keys[~found]), pa.array(n[~found])], PARTS)

    parts = scratch.saved(rows.select("row", "a", "b", "n").mapInArrow(run, ", ".join(f"{c} long" for c in PARTS)), "parts")
    rest = parts.filter("key IS NOT NULL").select("row", "key", "n").join(counts, "key")
    rest = rest.select("row", (F.col("n") * F.col("best").cast("long")).alias("n_best"), (F.col("n") * F.col("docs")).alias("count_sum"))
    sums = parts.filter("key IS NULL").select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("a", "b", "n").join(sums, "row").select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


PARTS = ["row", "n_best", "count_sum", "key", "n"]
