"""Secret scans by one combined deterministic automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.automaton import compiled


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern over ASCII bytes, and the least length of a match, or of its run of tail bytes."""

    kind: str
    pattern: str
    least: int = 0
    tail: bytes = b""


_VALUE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def _either_case(words: tuple[str, ...]) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


ASSIGN = "(?:" + _either_case(("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
BASE = (
    Rule("assign", ASSIGN, 6, _VALUE),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", "AIza[0-9A-Za-z_-]+", 39),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]+", 20),
    Rule("stripe", "[sr]k_(?:live|test)_[0-9A-Za-z]+", 24),
    Rule("jwt", "eyJ[0-9A-Za-z_-]+\\.eyJ[0-9A-Za-z_-]+\\.[0-9A-Za-z_-]+", 40),
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class Scanner:
    """Finds, for each rule by itself, matches that don't overlap, in one pass over a text's bytes.

    The combined automaton tells where a match of some rule ends first; the rule's reversed automaton then gives the
    leftmost beginning of a match that ends there, and its own automaton the longest match from there.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        patterns = [r.pattern for r in rules]
        self.rules, self.all = rules, compiled(patterns, floating=True)
        self.back = [compiled([p], reverse=True) for p in patterns]
        self.ahead = [compiled([p]) for p in patterns]

    def _extent(self, data: bytes, rule: int, low: int, at: int) -> tuple[int, int] | None:
        back, ahead = self.back[rule], self.ahead[rule]
        state, start = 0, -1
        for i in range(at, low - 1, -1):
            state = back.table[state + back.classes[data[i]]]
            if state >= back.first_end:
                start = i
            elif state == back.dead:
                break
        if start < 0:
            return None
        state, end = 0, start
        for i in range(start, len(data)):
            state = ahead.table[state + ahead.classes[data[i]]]
            if state >= ahead.first_end:
                end = i + 1
            elif state == ahead.dead:
                break
        return start, end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        table, rules, first_end, state = self.all.table, self.all.rules, self.all.first_end, 0
        done, found = [0] * len(self.rules), []
        for i, c in enumerate(data.translate(self.all.classes)):
            state = table[state + c]
            if state >= first_end:
                for rule in rules[state]:
                    if i >= done[rule] and (extent := self._extent(data, rule, done[rule], i)):
                        start, done[rule] = extent
                        if self._passes(self.rules[rule], data[start : done[rule]]):
                            found.append((start, rule, done[rule]))
        return sorted(found)

    @staticmethod
    def _passes(rule: Rule, match: bytes) -> bool:
        if not rule.tail:
            return len(match) >= rule.least
        # a value may begin with the sign that assigns it, of which only the first isn't part of it
        head = match.rstrip(rule.tail)
        value = match[len(head) :]
        if not head.rstrip(b"\"' ").endswith((b":", b"=")):
            value = value[value.index(b"=") + 1 :]
        return len(value) >= rule.least


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def text_spans(text: str | None, tool: Scanner) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = tool.spans(data)
    if found and len(data) != len(text):
        at = lambda n: len(data[:n].decode("utf-8", "surrogatepass"))
        found = [(at(s), rule, at(e)) for s, rule, e in found]
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col and spans (array of kind, start, end in code points, end exclusive; sorted by start, then kind as listed) of every row.

    Null and empty texts have no spans. Matches of one kind don't overlap, those of two kinds may. Repeated rows and
    null ids come out as they are; an empty table gives an empty table.
    """

    # the size of the automata depends on the rules alone
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            rows = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in text_spans(t, tool)] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def redact_secrets(text: str | None, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> str | None:
    """text with every span, overlapping ones as one, replaced by mark."""
    if text is None:
        return None
    out, at = [], 0
    for start, _, end in text_spans(text, scanner(rules)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])

