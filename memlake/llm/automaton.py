"""Deterministic byte automata for sets of rules: subset construction, minimisation, transition arrays."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser


@dataclass(frozen=True)
class Automaton:
    """classes: byte -> class; table: state * width + class -> state * width; rules: state -> rules that end there.

    States are numbered so that those where some rule ends come last, from first_end on. State 0 is the start and
    state dead, if there is one, reaches no end.
    """

    classes: bytes
    table: list[int]
    width: int
    rules: dict[int, tuple[int, ...]]
    first_end: int
    dead: int


def _bytes_of(items) -> frozenset[int]:
    found, negated = set(), False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            found.add(value)
        elif kind is op.RANGE:
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"{kind} in a class")
    return frozenset(set(range(256)) - found if negated else found)


class _Parts:
    """A nondeterministic automaton under construction. moves: state -> (bytes, state)."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, reverse: bool) -> int:
        """The state after tree, read from start; each piece is read backwards if reverse."""
        for kind, value in reversed(tree) if reverse else tree:
            end = self.state()
            if kind is op.LITERAL:
                self.moves[start].append((frozenset([value]), end))
            elif kind is op.IN:
                self.moves[start].append((_bytes_of(value), end))
            elif kind is op.SUBPATTERN:
                self.free[self.add(value[3], start, reverse)].append(end)
            elif kind is op.BRANCH:
                for branch in value[1]:
                    self.free[self.add(branch, start, reverse)].append(end)
            elif kind is op.MAX_REPEAT:
                least, most, inner = value
                for _ in range(least):
                    start = self.add(inner, start, reverse)
                self.free[start].append(end)
                if most is op.MAXREPEAT:
                    hub = self.state()
                    self.free[start].append(hub)
                    last = self.add(inner, hub, reverse)
                    self.free[last] += [hub, end]
                else:
                    for _ in range(most - least):
                        start = self.add(inner, start, reverse)
                        self.free[start].append(end)
            else:
                raise ValueError(f"{kind} in a rule")
            start = end
        return start


def compiled(patterns: list[str], floating: bool = False, reverse: bool = False) -> Automaton:
    """One automaton for all patterns of ASCII literals, classes, groups, alternatives and greedy repeats.

    floating: a rule may begin at any byte; else the first. reverse: texts are read from their ends.
    """
    parts = _Parts()
    start, ends = parts.state(), {}
    for n, pattern in enumerate(patterns):
        first = parts.state()
        parts.free[start].append(first)
        ends[parts.add(list(parser.parse(pattern)), first, reverse)] = n
    if floating:
        parts.moves[start].append((frozenset(range(256)), start))

    signatures: dict[tuple, int] = {}
    used = [s for moves in parts.moves for s, _ in moves]
    classes = bytes(signatures.setdefault(tuple(b in s for s in used), len(signatures)) for b in range(256))
    sample = {c: classes.index(c) for c in range(len(signatures))}

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in parts.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if parts.moves[s] or s in ends)

    subsets = {closed([start]): 0}
    rows, queue = [], list(subsets)
    for subset in queue:
        moves = [m for s in subset for m in parts.moves[s]]
        row = []
        for c in range(len(signatures)):
            target = closed({t for held, t in moves if sample[c] in held})
            if target not in subsets:
                subsets[target] = len(subsets)
                queue.append(target)
            row.append(subsets[target])
        rows.append(row)
    outs = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in queue]
    return _numbered(*_minimal(rows, outs), classes, len(signatures))


def _minimal(rows: list[list[int]], outs: list[tuple]) -> tuple[list[list[int]], list[tuple]]:
    """Moore's refinement: states stay together while their ends and their successors' blocks agree."""
    names: dict = {}
    block, blocks = [names.setdefault(o, len(names)) for o in outs], 0
    while len(names) > blocks:
        blocks, names = len(names), {}
        block = [names.setdefault((block[s], *[block[t] for t in row]), len(names)) for s, row in enumerate(rows)]
    picked = {b: s for s, b in reversed(list(enumerate(block)))}
    return [[block[t] for t in rows[picked[b]]] for b in range(blocks)], [outs[picked[b]] for b in range(blocks)]


def _numbered(rows: list[list[int]], outs: list[tuple], classes: bytes, width: int) -> Automaton:
    order = sorted(range(len(rows)), key=lambda s: (bool(outs[s]), s))
    place = {s: n for n, s in enumerate(order)}
    table = [place[t] * width for s in order for t in rows[s]]
    dead = next((place[s] * width for s in range(len(rows)) if not outs[s] and all(t == s for t in rows[s])), -1)
    first = next((n for n, s in enumerate(order) if outs[s]), len(order)) * width
    if place[0] != 0:
        raise ValueError("a rule may match nothing")
    return Automaton(classes, table, width, {place[s] * width: outs[s] for s in order if outs[s]}, first, dead)
