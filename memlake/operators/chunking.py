"""Cutting documents into chunks. The cutters are Python, one text at a time; all around them is Spark's."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as T

_SOLID = re.compile(r"\S")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: The ends of sentences that a long paragraph is cut after, best first.
STOPS = (". ", ".\n", "? ", "! ", "; ")
#: How the first line of a paragraph begins that is a heading, and its characters at most.
HEADINGS = (
    r"(Art\.|ARTICLE|Section|SECTION|TITOLO|TITLE|CAPO|CHAPTER)\s",
    r"\d+[.)]\s+[A-Z]",
    r"[A-Z][A-Z\s]{5,}$",
    r"[IVXLC]+[.)]\s",
    r"\d+\.\d+\s+[A-Z]",
)
HEADING_CHARS = 80
_HEADING = re.compile("|".join(HEADINGS))
#: Between sentences of a long paragraph under headings.
_NEXT = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\n")
_BLANK_LINES = re.compile(r"\n\s*\n")


#: Where a text may be cut, best first, and how many characters of the sign stay before the cut.
CUTS = (("\n\n", 0), ("\n", 0), (". ", 1), (" ", 0))


def greedy(text: str, most: int = 1200) -> list[str]:
    """Parts of at most so many characters, cut at the last paragraph, line, sentence or word end beyond 30 % of each.

    All places to cut are looked up once per kind of sign; a part takes the last place of the first kind that has one in reach.
    """
    places = [([m.start() for m in re.finditer(f"(?={re.escape(sign)})", text)], len(sign), kept) for sign, kept in CUTS]
    solid = len(text.rstrip())
    parts, start = [], 0
    while start < solid:
        end = solid
        if len(text) - start > most:
            near, end = start + most * 0.3, start + most
            for found, width, kept in places:
                last = bisect_right(found, start + most - width) - 1
                if last >= 0 and found[last] > near:
                    end = found[last] + kept
                    break
        parts.append(text[start:end].rstrip())
        start = next((m.start() for m in _SOLID.finditer(text, end)), solid)
    return [p for p in (*parts[:-1], *(p.strip() for p in parts[-1:])) if p]


def _packed(pieces: list[str], most: int, least: int, join: str) -> list[str]:
    """Pieces joined up to most characters; a last part under least goes to the one before where it fits twice over."""
    out: list[str] = []
    for p in pieces:
        if out and (len(out[-1]) + len(join) + len(p) <= most or len(out[-1]) < least and len(out[-1]) + len(p) <= most * 1.5):
            out[-1] += join + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(out[-1]) <= most * 1.5:
        out[-2:] = [out[-2] + join + out[-1]]
    return out


def _sentences(text: str, most: int) -> list[str]:
    return [x for p in _packed(_SENTENCE.split(text), most, 0, " ") for x in (greedy(p, most) if len(p) > most else [p])]


def _cut_after(text: str, most: int, signs: tuple[str, ...]) -> list[str]:
    """Stripped parts of at most so many characters, each cut after the last of the first sign that stands beyond 30 % of it, else before a blank there, else where it is full."""
    parts, start, near = [], 0, most * 0.3
    while len(text) - start > most:
        reach = start + most
        ends = [at + len(sign) for sign in signs if (at := text.rfind(sign, start, reach)) - start > near]
        blank = text.rfind(" ", start, reach)
        end = ends[0] if ends else blank if blank - start > near else reach
        parts.append(text[start:end].strip())
        start = next((m.start() for m in _SOLID.finditer(text, end)), len(text))
    return [p for p in (*parts, text[start:].strip()) if p]


def _pieces(text: str) -> list[str]:
    return [p.strip() for p in _BLANK_LINES.split(text) if p.strip()]


def _merged(parts: list[str], least: int) -> list[str]:
    """Parts under least characters take up the ones after them until they reach it; the last goes to the one before it."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) < least:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least:
        out[-2:] = ["\n\n".join(out[-2:])]
    return out


def paragraphs(text: str, most: int = 1200, least: int = 300) -> list[str]:
    """Paragraphs packed together up to most characters, and beyond while there are under least; long ones are cut at sentence ends, and what is left of them goes on. A short text is one part as it is."""
    if len(text) <= most:
        return [text] if text.strip() else []
    parts: list[str] = []
    open_ = False  # whether the last part may grow
    for p in _pieces(text):
        if len(p) > most:
            parts += _cut_after(p, most, STOPS)
            open_ = True
        elif open_ and (len(parts[-1]) + 2 + len(p) <= most or len(parts[-1]) < least):
            parts[-1] += "\n\n" + p
        else:
            parts.append(p)
            open_ = True
    return _merged(parts, least)


def _blocks(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text): fenced code, tables, prose. A fence ends at a line that begins with its own sign."""
    kind, held, sign = "prose", [], ""
    for line in text.split("\n"):
        begins = line.lstrip()[:3]
        fence = begins == sign if kind == "code" else begins in ("```", "~~~")
        sign = begins if fence else sign
        new = "code" if kind == "code" or fence else "table" if line.lstrip().startswith("|") else "prose"
        if new != kind and held:
            yield kind, "\n".join(held)
            held = []
        held.append(line)
        kind = new
        if fence and len(held) > 1:
            yield kind, "\n".join(held)
            kind, held = "prose", []
    if held:
        yield kind, "\n".join(held)


def markdown(text: str, most: int = 1200, least: int = 300) -> list[str]:
    """Fences stay whole, tables are cut between rows, prose at sentence ends."""
    pieces = []
    for kind, block in _blocks(text):
        if not block.strip():
            continue
        if kind == "code" or len(block) <= most:
            pieces.append(block.strip("\n"))
        elif kind == "table":
            pieces += _packed(block.split("\n"), most, 0, "\n")
        else:
            pieces += paragraphs(block, most, least)
    return _packed(pieces, most, least, "\n")


def is_heading(paragraph: str) -> bool:
    first = paragraph.split("\n", 1)[0].strip()
    return 0 < len(first) < HEADING_CHARS and bool(_HEADING.match(first))


def headings(text: str, target: int = 1200, most: int = 2000, least: int = 200) -> list[str]:
    """Paragraphs packed together up to target characters; a heading ends a part of more than least. Those over most are cut by sentences, apart from the others. A short text is one part."""
    text = text.strip()
    if len(text) <= target:
        return [text] if text else []
    parts: list[str] = []
    open_ = False
    for p in _pieces(text):
        if len(p) > most:
            sentences = _packed([s for s in _NEXT.split(p) if s.strip()], target, 0, " ")
            parts += [x for s in sentences for x in (_cut_after(s, target, ()) if len(s) > target else [s.strip()])]
            open_ = False
        elif open_ and len(parts[-1]) + 2 + len(p) <= target and not (is_heading(p) and len(parts[-1]) > least):
            parts[-1] += "\n\n" + p
        else:
            parts.append(p)
            open_ = True
    if open_ and len(parts) > 1 and len(parts[-1]) < least:
        parts[-2:] = ["\n\n".join(parts[-2:])]
    return parts


CUTTERS: dict[str, Callable[[str], list[str]]] = {"greedy": greedy, "paragraphs": paragraphs, "markdown": markdown, "headings": headings}


def cut(docs: DataFrame, method: str) -> DataFrame:
    """(doc_id, part, text): a row per part, in one narrow pass."""
    tool = CUTTERS[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, p) for i, t in zip(b["doc_id"], b["text"], strict=True) if t for n, p in enumerate(tool(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "text"]).astype({"part": "int32"})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, text string")


#: Fenced stretches of an array of lines: a fence ends at the next line that begins with the same sign.
_FENCES = """aggregate(filter(transform(lines, (x, i) -> struct(i AS i, substring(ltrim(x), 1, 3) AS sign)), x -> x.sign IN ('```', '~~~')),
  struct('' AS sign, 0 AS first, CAST(array() AS array<struct<first:int,last:int>>) AS spans),
  (s, x) -> IF(s.sign = '', struct(x.sign AS sign, x.i AS first, s.spans AS spans), IF(s.sign = x.sign, struct('' AS sign, 0 AS first, array_append(s.spans, struct(s.first AS first, x.i AS last)) AS spans), s)),
  s -> IF(s.sign = '', s.spans, array_append(s.spans, struct(s.first AS first, size(lines) AS last))))"""
_HEADS = "filter(sequence(0, size(lines) - 1), i -> lines[i] RLIKE '^#{2,3} ' AND NOT exists(fences, f -> i BETWEEN f.first AND f.last))"
_BLANKS = "' \\t\\n\\r'"


def split_markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, heading, text): a row for each H2 or H3 with the lines from it on, and one for what comes before the first.

    Lines in fences are no headings. Empty sections drop out; null texts have none.
    """
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n").alias("lines"))
    rows = rows.withColumn("fences", F.expr(_FENCES)).withColumn("heads", F.expr(_HEADS))
    rows = rows.withColumn("starts", F.expr("IF(get(heads, 0) = 0, heads, concat(array(0), heads))"))
    cut = f"transform(starts, (a, k) -> struct(IF(array_contains(heads, a), trim(ltrim('#', trim(lines[a]))), '') AS heading, trim(BOTH {_BLANKS} FROM array_join(slice(lines, a + 1, coalesce(get(starts, k + 1), size(lines)) - a), '\\n')) AS text))"
    kept = rows.select("doc_id", F.posexplode(F.filter(F.expr(cut), lambda s: s["text"] != "")).alias("section", "s"))
    return kept.select("doc_id", "section", "s.heading", "s.text")


def overlap(parts: DataFrame, chars: int = 200) -> DataFrame:
    """parts with the end of the part before put in front, from its first whole word on."""
    before = F.lag("text").over(W.partitionBy("doc_id").orderBy("part"))
    tail = F.trim(F.right(before, F.lit(chars)))
    tail = F.when(F.instr(tail, " ") > 0, F.substring(tail, F.instr(tail, " ") + 1, F.length(tail))).otherwise(tail)
    return parts.withColumn("tail", tail).withColumn("text", F.when(F.col("tail").isNotNull() & (F.col("tail") != ""), F.concat_ws("\n", "tail", "text")).otherwise(F.col("text"))).drop("tail")


def register_udtfs(spark) -> None:
    """The cutters as table functions of SQL: SELECT * FROM cut_greedy('…') gives (part, text)."""
    for name, tool in CUTTERS.items():

        class Cut:
            cutter = staticmethod(tool)

            def eval(self, text: str):
                yield from enumerate(self.cutter(text) if text else [])

        spark.udtf.register(f"cut_{name}", F.udtf(Cut, returnType="part: int, text: string"))


def build_chunks(docs: DataFrame, method: str = "greedy", marker: str = "kb") -> DataFrame:
    """docs (doc_id, text, filename, file_path) to chunk rows: cut, overlapped (Markdown isn't), named, typed."""
    parts = cut(docs, method)
    if method != "markdown":
        parts = overlap(parts)
    about = docs.select("doc_id", "filename", "file_path", T.doc_type(F.col("filename"), F.col("text")).alias("doc_type"), T.folder_of(F.col("file_path"), marker).alias("folder"))
    rows = parts.join(about, "doc_id")
    return rows.select(T.chunk_id(F.substring(F.sha2(F.col("file_path").cast("binary"), 256), 1, 12), F.col("part"), "doc").alias("chunk_id"), "doc_id", "part", "file_path", "doc_type", "folder", F.length("text").alias("char_count"), T.embedding_text(F.col("text")).alias("text"))


def rows_to_text(df: DataFrame, key: str, order: str, columns: list[str], most: int = 1200) -> DataFrame:
    """(key, block, text): rows as "first: column=value; …" lines, packed whole into blocks of at most so many characters that each begin with the header.

    Empty values are left out, and rows of nothing else. A longer row is a block of its own. Rows come sorted, so that a
    block at a time is held.
    """
    first, *rest = columns
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    values = F.nullif(F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), filled(c)) for c in rest]), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("place"), F.concat_ws(": ", filled(first), values).alias("line")).filter("line <> ''")
    header = " | ".join(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block, held, size = None, 0, [], 0
        for batch in batches:
            done = []
            for k, line in zip(batch["key"], batch["line"], strict=True):
                if held and (k != now or size + 1 + len(line) > most):
                    done.append((now, block, "\n".join([header, *held])))
                    held, block = [], block + 1
                if k != now:
                    now, block = k, 0
                size = (size if held else len(header)) + 1 + len(line)
                held.append(line)
            yield pd.DataFrame(done, columns=["key", "block", "text"]).astype({"block": "int32"})
        if held:
            yield pd.DataFrame([(now, block, "\n".join([header, *held]))], columns=["key", "block", "text"]).astype({"block": "int32"})

    kind = df.schema[key].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "place").mapInPandas(run, f"key {kind}, block int, text string").withColumnRenamed("key", key)


def delimited(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("line", F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
