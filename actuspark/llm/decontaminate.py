"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of 13 words. The shingles (3 words) of all items are ordered by rarity, that is by how often they
occur in the documents, and of each window only the rarest shingle, its prefix, is joined with the shingles of the documents:
a document that holds the window must hold that shingle. A match fixes where the window would have to start; the length bound
drops starts before the text's first word, the positional bound those whose last word lies beyond its end, and what is left
is verified word by word over the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import U64, Rolling, cover, joined, mapped, mix, slices


WINDOW, SHINGLE = 13, 3
#: Benchmark text that is broadcast at once; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 16 << 20

# A word is made of 0-9, a-z (A-Z lower-cased) and bytes above 0x7F.
LETTERS = np.zeros(256, np.uint8)
LETTERS[48:58], LETTERS[97:123], LETTERS[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and for each row the number of its first word (end as last entry)."""
    data, starts = joined(column)
    letters = LETTERS[data]
    edges = np.diff(np.concatenate([[0], (letters > 0).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Rolling(letters, 7).at(first, last), np.searchsorted(first, starts)


def combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(size):
        out = mix(out + hashes[i: i + n] + U64(i + 1))
    return out


class Items:
    """The windows of a block of items, with the prefix of each once the rarity of the shingles is known."""

    def __init__(self, ids: list, column: pa.Array):
        hashes, first = words(column)
        self.windows: list[np.ndarray] = []
        owners: list[set] = []
        where: dict[bytes, int] = {}
        for i, item in enumerate(ids):
            own = hashes[first[i]: first[i + 1]]
            for k in range(max(1, len(own) - WINDOW + 1) if len(own) else 0):
                window = own[k: k + WINDOW]
                at = where.setdefault(window.tobytes(), len(self.windows))
                if at == len(self.windows):
                    self.windows.append(window)
                    owners.append(set())
                if item is not None:
                    owners[at].add(str(item))
        self.names = sorted(set().union(*owners)) if owners else []
        number = {n: i for i, n in enumerate(self.names)}
        self.owner = np.array([number[n] for o in owners for n in sorted(o)], np.int64)
        self.owner_first = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.shingles = [combined(w, min(SHINGLE, len(w))) for w in self.windows]
        self.vocabulary = np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, U64)
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle; windows by shingle, as a sorted list."""
        prefix, offset = [], []
        for s in self.shingles:
            n = counts[np.searchsorted(self.vocabulary, s)]
            offset.append(int(np.argmin(n)))
            prefix.append(s[offset[-1]])
        order = np.argsort(np.array(prefix, U64), kind="stable")
        self.prefix, self.window, self.offset = np.array(prefix, U64)[order], order, np.array(offset, np.int64)[order]
        self.length = np.array([len(w) for w in self.windows], np.int64)[order]
        self.matrix = np.zeros((len(self.windows), WINDOW), U64)
        for row, i in enumerate(order):
            self.matrix[row, : len(self.windows[i])] = self.windows[i]

    def match(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, row of the window list) of all occurrences in the documents."""
        places, rows = [], []
        for size in self.sizes:
            shingle = combined(hashes, size)
            lo, hi = np.searchsorted(self.prefix, shingle), np.searchsorted(self.prefix, shingle, side="right")
            hit = np.flatnonzero(hi > lo)
            many = hi[hit] - lo[hit]
            place = np.repeat(hit, many)
            row = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            right = np.minimum(self.length[row], SHINGLE) == size
            places.append(place[right])
            rows.append(row[right])
        place, row = np.concatenate(places), np.concatenate(rows)
        doc = np.searchsorted(first, place, side="right") - 1
        start = place - self.offset[row]
        inside = (start >= first[doc]) & (start + self.length[row] <= first[doc + 1])
        start, row = start[inside], row[inside]
        ok = np.ones(len(start), bool)
        for k in range(WINDOW):
            beyond = k >= self.length[row]
            ok &= beyond | (hashes[np.minimum(start + k, len(hashes) - 1)] == self.matrix[row, k])
        return start[ok], row[ok]


def blocks(items: DataFrame, limit: int) -> Iterator[pa.Table]:
    """The items in blocks of about ``limit`` bytes; nothing larger is ever fetched."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // limit) or 1
    cut = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for i in range(parts):
        yield (items if parts == 1 else items.where(cut == i)).toArrow()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document.

    A word is hit if it lies in an occurrence of a 13-word window of an item (of the whole item if it is shorter); a document
    is contaminated if some word is hit and hits times ``share`` reach its words. Null texts have no words; empty items match
    nothing; an item without an id hits words but is not listed; of repeated items each is listed once. Repeated rows come out
    as often as they come in; empty tables give no rows or no hits; other columns may have any names.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    found = _matched(base, ["id"], items, item_id, item_text, share, block_bytes)
    return found.withColumnRenamed("id", doc_id)


def clean_only(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text is not contaminated, with all their columns; the same rules and edge cases as ``contamination``."""
    others = [c for c in docs.columns if c != text]
    held = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").alias("text"))
    found = _matched(held, ["row", "text"], items, item_id, item_text, 20, BLOCK_BYTES)
    return found.where(~F.col("contaminated")).select("row.*", F.col("text").alias(text)).select(docs.columns)


def _matched(base: DataFrame, carry: list[str], items: DataFrame, item_id: str, item_text: str, share: int, limit: int) -> DataFrame:
    spark = base.sparkSession
    held = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    lists = [Items(t.column("item").to_pylist(), t.column("text").combine_chunks()) for t in blocks(held, limit)]
    for part in lists:
        part.order(_rarity(base, part))
    shared = [spark.sparkContext.broadcast(part) for part in lists if part.windows]
    kept = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            hashes, first = words(piece.column("text"))
            n = piece.num_rows
            lo, hi, named = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [set() for _ in range(n)]
            for part in (b.value for b in shared):
                start, row = part.match(hashes, first)
                lo.append(start)
                hi.append(start + part.length[row])
                doc = np.searchsorted(first, start, side="right") - 1
                for d, w in np.unique(np.stack([doc, part.window[row]]), axis=1).T if len(start) else ():
                    named[d].update(part.names[i] for i in part.owner[part.owner_first[w]: part.owner_first[w + 1]])
            hit = np.concatenate([[0], np.cumsum(cover(np.concatenate(lo), np.concatenate(hi), len(hashes)))])
            n_words, n_hit = np.diff(first), np.diff(hit[first])
            own = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()),
                   pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in named]),
                   pa.array((n_hit > 0) & (share * n_hit >= n_words))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carry), *own],
                                             [*carry, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return mapped(base, run, f"{kept}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _rarity(base: DataFrame, part: Items) -> np.ndarray:
    """How often each shingle of the items occurs in the documents: one count for each shingle, added up in Spark."""
    if not len(part.vocabulary):
        return np.zeros(0, np.int64)
    vocabulary = base.sparkSession.sparkContext.broadcast((part.vocabulary, part.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for piece in slices(batches, "text"):
            hashes, first = words(piece.column("text"))
            for size in sizes:
                shingle = combined(hashes, size)
                at = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
                doc = np.searchsorted(first, np.arange(len(shingle)), side="right") - 1
                hit = (known[at] == shingle) & (np.arange(len(shingle)) + size <= first[doc + 1])
                total += np.bincount(at[hit], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["shingle", "n"])

    counts = mapped(base.select("text"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(part.vocabulary), np.int64)
    out[counts.column("shingle").to_numpy()] = counts.column("n").to_numpy()
    vocabulary.unpersist()
    return out
