"""Secrets in texts: one deterministic automaton for all rules, run once over the bytes.

Each rule is a small regular expression. Its states are ordered lists of places in the expression, earliest start first, as a
leftmost match needs them; the combined automaton is the reachable product of the rules' lists (subset construction), reduced to
byte classes and minimised by splitting states until every class agrees. A state says which rules are inside a match.

The bytes of a slice of texts are cut into equal lanes that step through the transition array side by side. Lanes start in the
first state; a lane before which the text ends in another state is walked again until its states agree, a few bytes as a rule, so
the result is that of one pass from left to right. A match begins to be one at its first accepting byte and ends with its last one. Its start is found by
the automaton of the reversed expression, from the first accepting byte to the left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import joined, mapped, runs, slices


class Rule(NamedTuple):
    """``least``: bytes from the first at which the pattern is complete to the end of the match; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 1


ASSIGN = Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8)
ACCESS = Rule("access", "AKIA[A-Z0-9]+", 12)
HEX = Rule("hex", "[0-9a-f]+", 32)
BASE = (ASSIGN, ACCESS, HEX)
#: Fixed forms of further credentials: forge tokens, signed web tokens, headers of private keys.
MORE = (Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 36), Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 16),
        Rule("pem", "-----BEGIN[A-Z ]*PRIVATE KEY-----"))

LANES = 2048


# --- expressions: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None) ---

def parse(pattern: str) -> tuple:
    """Literals, escapes, classes, groups, ``(?i:...)`` for ASCII letters, ``|``, ``?``, ``*``, ``+``."""
    at = 0

    def char() -> int:
        nonlocal at
        c, at = pattern[at], at + 1
        if c == "\\":
            c, at = pattern[at], at + 1
            if c == "x":
                at += 2
                return int(pattern[at - 2:at], 16)
        if not 0 < ord(c) < 128:
            raise ValueError(f"{pattern}: only ASCII characters are supported")
        return ord(c)

    def either_case(members: set[int], fold: bool) -> frozenset[int]:
        swapped = {c ^ 32 for c in members if chr(c).isalpha()} if fold else set()
        return frozenset(members | swapped)

    def atom(fold: bool) -> tuple:
        nonlocal at
        if pattern[at] == "(":
            inner = pattern.startswith("(?i:", at)
            at += 4 if inner else 1
            found = choice(fold or inner)
            at += 1
            return found
        if pattern[at] != "[":
            return "set", either_case({char()}, fold)
        at += 1
        members: set[int] = set()
        while pattern[at] != "]":
            low = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                members.update(range(low, char() + 1))
            else:
                members.add(low)
        at += 1
        return "set", either_case(members, fold)

    def sequence(fold: bool) -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom(fold)
            if at < len(pattern) and pattern[at] in "?*+":
                part = ("rep", part, int(pattern[at] == "+"), 1 if pattern[at] == "?" else None)
                at += 1
            parts.append(part)
        return "cat", parts

    def choice(fold: bool) -> tuple:
        nonlocal at
        parts = [sequence(fold)]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence(fold))
        return "alt", parts

    return choice(False)


class Places:
    """The places of an expression: bytes that lead on, or free moves in order of preference. The last place is the end."""

    def __init__(self, tree: tuple, backwards: bool = False):
        self.moves: list[tuple[frozenset[int] | None, list[int]]] = [(None, [])]
        self.end = 0
        self.start = self._add(tree, self.end, backwards)

    def _new(self, members: frozenset[int] | None, targets: list[int]) -> int:
        self.moves.append((members, targets))
        return len(self.moves) - 1

    def _add(self, tree: tuple, after: int, backwards: bool) -> int:
        if tree[0] == "set":
            return self._new(tree[1], [after])
        if tree[0] == "cat":
            for part in tree[1] if backwards else reversed(tree[1]):
                after = self._add(part, after, backwards)
            return after
        if tree[0] == "alt":
            return self._new(None, [self._add(part, after, backwards) for part in tree[1]])
        _, part, least, most = tree
        loop = self._new(None, [])
        inside = self._add(part, after if most == 1 else loop, backwards)
        self.moves[loop][1].extend([inside, after])
        return inside if least else loop

    def reach(self, places: Sequence[int]) -> tuple[int, ...]:
        """The places with bytes, and the end, that free moves lead to, in order of preference."""
        found, seen, todo = [], set(), list(reversed(places))
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            if self.moves[p][0] is None and p != self.end:
                todo.extend(reversed(self.moves[p][1]))
            else:
                found.append(p)
        return tuple(found)

    def step(self, places: Sequence[int], byte: int) -> tuple[int, ...]:
        return self.reach([t for p in places if self.moves[p][0] and byte in self.moves[p][0] for t in self.moves[p][1]])


class Search:
    """A rule's search as an automaton: leftmost matches, the longest continuation, and a new search at the end of each."""

    def __init__(self, rule: Rule):
        self.rule, self.places, self.known = rule, Places(parse(rule.pattern)), {}
        self.fresh = self.places.reach([self.places.start])
        if self.places.end in self.fresh:
            raise ValueError(f"{rule.kind}: the empty text matches")
        #: Places whose byte completes a match.
        self.tail = {p for p, (members, to) in enumerate(self.places.moves) if members and self.places.end in self.places.reach(to)}

    def inside(self, state: tuple[int, ...]) -> bool:
        return self.places.end in state

    def step(self, state: tuple[int, ...], byte: int) -> tuple[int, ...]:
        if (state, byte) not in self.known:
            self.known[state, byte] = self._step(state, byte)
        return self.known[state, byte]

    def _step(self, state: tuple[int, ...], byte: int) -> tuple[int, ...]:
        end, onward = self.places.end, self.places.step(state, byte)
        if self.inside(state):
            if onward and end not in onward:
                raise ValueError(f"{self.rule.kind}: a match that goes on has to stay a match")
            if onward:
                return self._cut(onward)
            found = self.places.step(self.fresh, byte)
            if end in found:
                raise ValueError(f"{self.rule.kind}: a match would touch the one before it")
            return found
        return self._cut(onward + tuple(p for p in self.places.step(self.fresh, byte) if p not in onward))

    def _cut(self, state: tuple[int, ...]) -> tuple[int, ...]:
        """In a match later starts are given up; a match that an earlier start could still take over is refused."""
        end = self.places.end
        if end not in state:
            return state
        if any(p not in self.tail for p in state[:state.index(end)]):
            raise ValueError(f"{self.rule.kind}: an earlier start could still match")
        return tuple(p for p in state if p in self.tail or p == end)


class Automaton(NamedTuple):
    classes: np.ndarray  # byte -> class
    moves: np.ndarray    # state * n_classes + class -> state * n_classes
    inside: np.ndarray   # state * n_classes -> bits of the rules that are inside a match
    width: int           # n_classes


@lru_cache(maxsize=8)
def combined(rules: tuple[Rule, ...]) -> Automaton:
    """The minimal automaton of all rules."""
    searches = [Search(r) for r in rules]
    sets = sorted({m for s in searches for m, _ in s.places.moves if m}, key=sorted)
    if any(0 in m for m in sets):
        raise ValueError("a rule may not take zero bytes: they part the texts")
    kinds: dict[tuple[bool, ...], int] = {}
    classes = np.array([kinds.setdefault(tuple(b in m for m in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]
    first = tuple(() for _ in searches)
    number, todo, table = {first: 0}, [first], []
    while todo:
        state = todo.pop(0)
        row = []
        for byte in sample:
            to = tuple(s.step(x, byte) for s, x in zip(searches, state))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    moves = np.array(table)
    inside = np.array([sum(s.inside(x) << i for i, (s, x) in enumerate(zip(searches, state))) for state in number], np.int64)
    block = np.unique(inside, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # The first state keeps number 0.
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    rest = iter(range(1, block.max() + 1))
    for b in range(block.max() + 1):
        order[b] = 0 if b == block[0] else next(rest)
    block = order[block]
    at = np.unique(block, return_index=True)[1]
    width = len(sample)
    spread = np.zeros(len(at) * width, np.uint8 if len(rules) <= 8 else np.int64)
    spread[::width] = inside[at]
    return Automaton(classes, (block[moves[at]] * width).reshape(-1).astype(np.int32), spread, width)


def states(machine: Automaton, data: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The state after each byte, scaled by the number of classes."""
    if not len(data):
        return np.zeros(0, np.int32)
    high = -(-len(data) // lanes)
    lanes = -(-len(data) // high)
    held = np.zeros(lanes * high, np.uint8)
    held[:len(data)] = data
    kinds = machine.classes[held].reshape(lanes, high)
    steps, out, now = np.ascontiguousarray(kinds.T), np.empty((high, lanes), np.int32), np.zeros(lanes, np.int32)
    for i in range(high):
        now = np.take(machine.moves, now + steps[i], out=out[i])
    out = np.ascontiguousarray(out.T)
    ends, moves, end = out[:, -1].tolist(), machine.moves.tolist(), 0
    for lane in range(lanes):
        if end:  # begun in the first state, but the text before ends in another one
            now, row, after = end, out[lane].tolist(), []
            for kind, assumed in zip(kinds[lane].tolist(), row):
                now = moves[now + kind]
                if now == assumed:
                    break
                after.append(now)
            else:
                ends[lane] = now
            out[lane, :len(after)] = after
        end = ends[lane]
    return out.reshape(-1)[:len(data)]


class Backwards:
    """The automaton of a reversed rule, built as far as matches need it."""

    def __init__(self, rule: Rule):
        self.places, self.known = Places(parse(rule.pattern), backwards=True), {}
        self.fresh = self.places.reach([self.places.start])

    def start(self, data: bytes, low: int, at: int) -> int:
        """The least start, not before ``low``, of a match that ends with the byte ``at``."""
        state, found = self.fresh, at
        while at >= low and state:
            key = state, data[at]
            if key not in self.known:
                self.known[key] = self.places.step(*key)
            state = self.known[key]
            if self.places.end in state:
                found = at
            at -= 1
        return found


def matches(machine: Automaton, rules: tuple[Rule, ...], data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, rule, end) of all matches in texts that zero bytes part, in this order."""
    inside = machine.inside[states(machine, data)]
    raw, found = data.tobytes(), []
    for i, rule in enumerate(rules):
        first, ends = runs(inside & (1 << i) != 0)
        back = Backwards(rule)
        for k in np.flatnonzero(ends - first >= rule.least).tolist():
            low = int(ends[k - 1]) if k else 0
            found.append((back.start(raw, low, int(first[k])), i, int(ends[k])))
    return sorted(found)


def scanned(machine: Automaton, rules: tuple[Rule, ...], names: list[str], out: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, begins = joined(piece.column("text"))
            spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            hits = matches(machine, rules, data)
            owner = np.searchsorted(begins, [s for s, _, _ in hits], side="right") - 1
            chars: dict[int, np.ndarray] = {}
            for (start, rule, end), doc in zip(hits, owner.tolist()):
                if doc not in chars:  # code points before each byte
                    part = data[begins[doc]:begins[doc + 1]]
                    chars = {doc: np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])}
                a, b = start - int(begins[doc]), end - int(begins[doc])
                spans[doc].append({"kind": rules[rule].kind, "start": int(chars[doc][a]), "end": int(chars[doc][b]),
                                   "match": data[start:end].tobytes().decode()})
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(spans, out)], [*names, "spans"])

    return run


def secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: (kind, start, end, match) of every match, by start, then in the order of ``rules``.

    Matches of a rule are leftmost and do not overlap; those shorter than the rule allows are found, and dropped afterwards.
    Places count code points, the end is exclusive. A null or empty text has no spans, equal rows give equal rows, an empty table
    an empty one; other columns of ``docs`` don't matter. A text and about 20 bytes for each of its bytes are held in a task.
    Rules whose matches a single pass cannot tell apart are refused with a ValueError.
    """
    rules = tuple(rules)
    held = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("match", pa.string())]))
    kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{kinds}{', ' if kinds else ''}spans array<struct<kind: string, start: bigint, end: bigint, match: string>>"
    return mapped(held, scanned(combined(rules), rules, names, span), schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "spans")
