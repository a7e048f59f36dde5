"""Periodic runs of words: maximal stretches that repeat with a period, at least three times, found by recompression.

The words of a slice of texts become one sequence of exact numbers, parted by symbols that occur once. Recompression alternates
two steps until every text is short: block compression replaces each maximal run of one symbol by a symbol for (symbol, length),
pair compression deals the symbols to left and right by a hash of their number and replaces each left-right pair. Equal stretches
are parsed alike but for their edges, and equal phrases get equal numbers (by sorting the phrases, not by hashing), so the levels
form a run-length grammar of the sequence. The longest common extension of two places climbs the levels while both places are
edges of phrases, comparing at most two symbols a level, and comes down where symbols first differ: logarithmic, exact, to both
sides alike.

Candidates: a run of period q and length n >= max(least, exponent * q) has n - q places x with word x = word x + q, so one of
them is a multiple of max(least - q, (exponent - 1) * q). For every q the places of this grid whose words agree are extended by
the grammar; the grids of all q have a harmonic number of places. A stretch keeps the smallest of its periods.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import U64, cover, mapped, mix, slices, texts

LEAST, EXPONENT = 24, 3
#: Texts of so many symbols are short enough: the extension compares them one by one.
SHORT = 4
#: Candidates that are extended together.
CHUNK = 1 << 20


class Level(NamedTuple):
    """A sequence of symbols and how it is parsed into the phrases that are the symbols of the next level."""

    symbols: np.ndarray
    phrase: np.ndarray  # of each symbol, and of the end
    first: np.ndarray   # symbol of each phrase, and the end
    blocks: bool        # phrases are runs of one symbol, else single symbols and pairs


class Grammar:
    """Recompression of ``symbols``; negative ones part the texts, occur once, and stand at both ends."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        self.top = symbols.astype(np.int64)
        for salt in count():
            self._compress(self._block_starts(), True)
            # The rest of a text of few symbols is compared one by one.
            if np.diff(np.flatnonzero(self.top < 0)).max(initial=0) <= SHORT + 1:
                break
            self._compress(self._pair_starts(salt), False)

    def _block_starts(self) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], self.top[1:] != self.top[:-1]]))

    def _pair_starts(self, salt: int) -> np.ndarray:
        left = mix(self.top.view(U64) + U64(salt * 0x9E3779B97F4A7C15 % 2**64)) & U64(1) == 1
        inner = self.top >= 0
        second = np.concatenate([[False], left[:-1] & ~left[1:] & inner[:-1] & inner[1:]])
        return np.flatnonzero(~second)

    def _compress(self, starts: np.ndarray, blocks: bool) -> None:
        n = len(self.top)
        if len(starts) == n:
            return
        first = np.concatenate([starts, [n]])
        sizes = np.diff(first)
        phrase = np.concatenate([np.repeat(np.arange(len(starts)), sizes), [len(starts)]])
        self.levels.append(Level(self.top.astype(np.int32), phrase.astype(np.int32), first.astype(np.int32), blocks))
        head = self.top[starts]
        more = sizes if blocks else np.where(sizes == 2, self.top[np.minimum(starts + 1, n - 1)] + 1, 0)
        keys = head * (int(more.max()) + 1) + more
        inner = head >= 0
        after = head.copy()
        after[inner] = np.unique(keys[inner], return_inverse=True)[1]
        self.top = after

    def extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many symbols agree from places ``a`` and ``b`` on, forwards (``way`` 1) or backwards (-1). ``a`` and ``b`` differ."""
        back = 0 if way == 1 else 1
        u, v = a.astype(np.int64), b.astype(np.int64)
        stopped = np.full(len(a), len(self.levels))

        def agree(symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
            return symbols[u[i] - back] == symbols[v[i] - back]

        def left_in(level: Level, x: np.ndarray) -> np.ndarray:
            """Symbols from ``x`` to the edge of its phrase."""
            return level.first[level.phrase[x] + 1] - x if way == 1 else x - level.first[level.phrase[x - 1]]

        def advance(level: Level | None, i: np.ndarray) -> None:
            by = way * np.minimum(left_in(level, u[i]), left_in(level, v[i])) if level is not None and level.blocks else way
            u[i] += by
            v[i] += by

        climbing = np.arange(len(a))
        for k, level in enumerate(self.levels):
            inside = climbing
            while len(inside):
                edges = (level.first[level.phrase[u[inside]]] == u[inside]) & (level.first[level.phrase[v[inside]]] == v[inside])
                inside = inside[~edges]
                same = agree(level.symbols, inside)
                stopped[inside[~same]] = k
                inside = inside[same]
                advance(level, inside)
            climbing = climbing[stopped[climbing] > k]
            u[climbing], v[climbing] = level.phrase[u[climbing]], level.phrase[v[climbing]]
        while len(climbing):
            climbing = climbing[agree(self.top, climbing)]
            advance(None, climbing)
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            above = np.flatnonzero(stopped > k)
            u[above], v[above] = level.first[u[above]], level.first[v[above]]
            while len(above):
                above = above[agree(level.symbols, above)]
                advance(level, above)
        return (u - a) * way


def periodic(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of the runs in ``symbols``, which negative symbols part and enclose; ascending."""
    parts = np.flatnonzero(symbols < 0)
    longest = int(np.diff(parts).max(initial=1)) - 1
    x, y = [], []
    for q in range(1, longest // exponent + 1):
        places = np.arange(0, len(symbols) - q, max(least - q, (exponent - 1) * q))
        places = places[symbols[places] == symbols[places + q]]
        x.append(places)
        y.append(places + q)
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (x, y))
    inside = np.searchsorted(parts, x) == np.searchsorted(parts, y)
    x, y = x[inside], y[inside]
    if not len(x):
        return np.zeros((0, 3), np.int64)
    grammar, found = Grammar(symbols), np.zeros((0, 3), np.int64)
    for i in range(0, len(x), CHUNK):
        a, b = x[i:i + CHUNK], y[i:i + CHUNK]
        start, end = a - grammar.extend(a, b, -1), b + grammar.extend(a, b, 1)
        fits = (end - start >= least) & (end - start >= exponent * (b - a))
        found = np.unique(np.concatenate([found, np.column_stack([start, end, b - a])[fits]]), axis=0)
    # Of one stretch only the smallest period counts: the others are its multiples.
    again = np.concatenate([[False], (found[1:, :2] == found[:-1, :2]).all(axis=1)]) if len(found) else np.zeros(0, bool)
    return found[~again]


def marked(names: list[str], least: int, exponent: int, out: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            words = [t.split() for t in texts(piece.column("text"))]
            numbers: dict[bytes, int] = {}
            sequence, offset, at = [[-1]], {}, 1
            for i, w in enumerate(words):
                if len(w) >= least:
                    offset[i], at = at, at + len(w) + 1
                    sequence += [[numbers.setdefault(x, len(numbers)) for x in w], [-at]]
            spans: list[list[dict]] = [[] for _ in words]
            kept = [b" ".join(w) for w in words]
            if offset:
                found = periodic(np.fromiter((s for part in sequence for s in part), np.int64, at), least, exponent)
                owners, begins = list(offset), np.array(list(offset.values()))
                owner = np.searchsorted(begins, found[:, 0], side="right") - 1
                for d in np.unique(owner).tolist():
                    i, rows = owners[d], found[owner == d] - np.array([begins[d], begins[d], 0])
                    rows = rows[np.lexsort([rows[:, 2], rows[:, 0]])]
                    spans[i] = [{"start": s, "length": e - s, "period": q} for s, e, q in rows.tolist()]
                    gone = cover(rows[:, 0] + rows[:, 2], rows[:, 1], len(words[i]))
                    kept[i] = b" ".join([w for w, g in zip(words[i], gone.tolist()) if not g])
            made = [pa.array([len(w) for w in words], pa.int64()), pa.array(spans, out), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *made], [*names, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT,
                  keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_words``, ``runs`` (start, length, period, in words, by start, then period) and ``collapsed``.

    Words are what the six ASCII blanks part. A run is a stretch of at least ``least`` words and ``exponent`` of its smallest
    periods that no neighbouring word extends. ``collapsed`` joins by one blank the words that no run holds after its first
    period. Null, empty and blank texts have no words, no runs and an empty ``collapsed``; runs never cross rows; equal rows give
    equal rows, an empty table an empty one; other columns of ``docs`` don't matter. A text is held whole in a task, with about
    120 bytes for each of its words.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has at least two words and two periods")
    held = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = "".join(f"{n} {held.schema[n].dataType.simpleString()}, " for n in names)
    schema = f"{kinds}n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    found = mapped(held, marked(names, least, exponent, span), schema)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_words", "runs", "collapsed")
