"""WARC archives: writing with revisit records, reading back, and merging the index of captures."""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.tables import Scratch, join_to_groups

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
INDEX = "page_id long, url string, urlkey string, captured string, file string, offset long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The sort key of a URL: host labels from the last, then path and query; no scheme, leading www, port 80 or 443, or fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail.lower()


def _record(page_id, url, html, captured: datetime, refers_to) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|{}^\"<>\\`")),
        ("WARC-Date", captured.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", "0" if revisit else str(len(payload))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + (b"" if revisit else payload) + b"\r\n\r\n"


INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:page:info>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n"
#: Bytes of compressed records that are handed to Spark's writer together, and how many such lots make an archive.
LOT, LOTS = 4_000_000, 16


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member of its own, which ends in a zero byte.

    A member's last four bytes are the size of what it holds, least byte first, so that the last is zero under 16 MB. A
    larger record is followed by an empty member.
    """
    tool = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = tool.compress(record) + tool.flush()
    return out if out.endswith(b"\0") else out + gzip_member(b"")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """WARC files of gzip members, one for each record, with a record for every row of pages; a file holds LOTS lots of LOT bytes at most, and what their last records add.

    Of rows with equal payloads of min_bytes or more, that with the largest id becomes the response and others revisit
    it; smaller payloads are all responses. Null html is an empty payload, a null url an empty one. Rows that repeat
    the largest id and payload are all responses; rows without an id are too, unless another has their payload. Ids are
    whole numbers, or text that reads as such. Captures are dated by their id in seconds from 1970. Spark's text writer
    makes the files, so that any file system it knows will do and lost tasks are written again; the zero byte that each
    lot ends in is its line end. No pages give no records.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    large = rows.filter(F.octet_length("html") >= min_bytes).select("id", "digest")
    best = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = join_to_groups(large.distinct(), best, "digest", "n", "id").filter("refers_to IS NOT NULL AND NOT (id <=> refers_to)").select(F.col("id").alias("i"), F.col("digest").alias("d"), "refers_to")
    marked = rows.join(revisits, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left").select("id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [gzip_member(INFO)], 0
        for batch in batches:
            for k in range(batch.num_rows):
                i, u, h, r = (c[k].as_py() for c in batch.columns)
                held.append(gzip_member(_record(i, u, h, EPOCH + timedelta(seconds=max(0, min(i or 0, 2**37))), r)))
                size += len(held[-1])
                if size >= LOT:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    lots = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lots.write.option("lineSep", "\0").option("maxRecordsPerFile", LOTS).text(path)


#: Bytes of an archive that a decompressor is handed at a time. What it leaves of them is copied once per member.
SLICE = 1 << 14


def members(data: bytes | memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset, plain bytes) of each gzip member, in time that grows with the archive's size."""
    at, view = 0, memoryview(data)
    while at < len(view):
        tool, plain, end = zlib.decompressobj(31), [], at
        while not tool.eof:
            if end == len(view):
                raise ValueError(f"the gzip member at byte {at} is cut off")
            plain.append(tool.decompress(view[end : end + SLICE]))
            end = min(end + SLICE, len(view))
        yield at, b"".join(plain)
        at = end - len(tool.unused_data)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, content) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def record_at(archive: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """(fields, content) of the record whose member begins at an index entry's offset."""
    return parsed(next(members(memoryview(archive)[offset:]))[1])


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _run_of(file: str, content: bytes) -> list[tuple]:
    """The index entries of an archive, sorted by URL key, date and page; offset is where a record's member begins."""
    found = []
    for offset, record in members(content):
        if not record:
            continue
        fields, payload = parsed(record)
        if fields["warc-type"] == "warcinfo":
            continue
        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
        if fields["warc-type"] == "response" and (digest, size) != (sha1_base32(payload), len(payload)):
            raise ValueError(f"{file}: the record at {offset} differs from its digest")
        url = fields["warc-target-uri"]
        found.append((_page(fields["warc-record-id"]), url, url_key(url), fields["warc-date"], file, offset, fields["warc-type"], size, digest, _page(fields.get("warc-refers-to"))))
    found.sort(key=_order)
    return found


def _order(entry: tuple) -> tuple:
    return entry[2], entry[3], entry[0] is not None, entry[0] or 0, entry[4], entry[5]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of all archives in path: a sorted run for each file.

    Payloads are checked against their digests; a record that differs, and a member that is cut off, raise an error. Entries
    of records without a page have a null page_id, those that revisit nothing a null refers_to. Archives without records
    give no entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(_run_of(file, content), columns=NAMES).astype({"page_id": "Int64", "refers_to": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, INDEX)


NAMES = [c.split()[0] for c in INDEX.split(", ")]


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so that a new leaf replays one path."""

    def __init__(self, runs: Iterable[Iterator], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.size)
        for leaf in range(self.size):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.size and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = head = next(self.runs[winner], None)
            self.keys[winner] = None if head is None else self.key(head)
            self._replay(winner)


#: Entries of a range that one task merges, about, and of a segment of a run, at most.
RANGE, SEGMENT = 100_000, 5_000
#: Sampled entries for each range, from which the driver takes where ranges begin.
SAMPLED = 20


def _entries(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _boundaries(runs: DataFrame, n: int, ranges: int) -> list[tuple]:
    """The keys at which ranges of about equal size begin, but the first."""
    sampled = runs.filter(F.pmod(F.xxhash64("file", "offset"), F.lit(max(1, n // (ranges * SAMPLED)))) == 0)
    keys = sorted(_order(tuple(r)) for r in sampled.select(*NAMES).collect())
    return [keys[k * len(keys) // ranges] for k in range(1, ranges)] if len(keys) >= ranges else keys


def merge_index(index: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """The entries of all runs in order of URL key, date and page: a range to each partition, in the order of the partitions.

    The runs are written as read_index() sorted them, and never sorted again. A task that reads some of them cuts each,
    wherever a range ends, into segments, and a segment travels as one row. The task of a range puts each run's segments
    in their place and merges the runs by a loser tree; it holds the range's segments packed, and one of each run
    unpacked. Ranges are of about equal size for any keys, as the page and the place in an archive tell captures of one
    URL apart, and so many that one holds range_rows entries or so; the driver holds SAMPLED keys for each. No entries
    give an empty table.
    """
    scratch, spark = Scratch(index.sparkSession), index.sparkSession
    runs = scratch.saved(index.select(*NAMES), "runs")
    n = runs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // range_rows))
    bounds = spark.sparkContext.broadcast(_boundaries(runs, n, ranges))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run, place, last = TaskContext.get().partitionId(), 0, 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, SEGMENT):
                batch = whole.slice(at, SEGMENT)
                starts, parts = [], []
                for k, key in enumerate(map(_order, _entries(batch))):
                    run += last is not None and key < last
                    last, part = key, (bisect_right(bounds.value, key), task << 32 | run)
                    if not parts or parts[-1] != part:
                        starts.append(k)
                        parts.append(part)
                for k, end, (part, own) in zip(starts, [*starts[1:], batch.num_rows], parts):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(k, end - k))
                    place += 1
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "run": [own], "place": [place], "segment": [sink.getvalue().to_pybytes()]})

    segments = runs.mapInArrow(cut, "part int, run long, place long, segment binary")

    def unpacked(packed: list[bytes]) -> Iterator[tuple]:
        for segment in packed:
            for batch in pa.ipc.open_stream(segment):
                yield from _entries(batch)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for own, segment in zip(batch.column("run").to_pylist(), batch.column("segment").to_pylist()):
                parts.setdefault(own, []).append(segment)
        tree = iter(LoserTree([unpacked(p) for p in parts.values()], _order))
        while out := list(islice(tree, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

    return segments.repartitionById(ranges, F.col("part")).sortWithinPartitions("run", "place").mapInArrow(merged, INDEX)


TYPES = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in INDEX.split(", ")]
