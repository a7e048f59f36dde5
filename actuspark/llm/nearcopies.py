"""Near copies of whole documents: pairs whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Documents with equal sets are one class. SimHash fingerprints over the set's 64 bits are compared in tiles with exclusive-or and
bit counts, and population counts further apart than the radius are skipped; 20 bits are 3.5 deviations above the mean distance at
similarity 0.8 (9.7, 2.9 bits). No block of bits has to agree at that radius, so tiles are dealt by min-hashes: twenty keys of
three each, of which a pair at 0.8 shares none once in a million. A tile sends a row on only in links of a spanning forest.

These links are candidates. Their components, as a rule a few documents, are the units of verification: the sets of a component
come together, every pair in reach is counted exactly, and again only a spanning forest of verified links leaves the task, less
than one link a row; what is refuted never does. Crowded keys and large components are split by salts into tiles of bounded size,
which meet in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import U64, mapped, mix, slices, texts
from actuspark.llm.components import components
from actuspark.session import materialize

SHINGLE, RADIUS = 5, 20
BANDS, PER_BAND = 20, 3
#: Rows of a tile, and shingles of a tile of whole sets.
TILE_ROWS, TILE_SHINGLES = 4096, 1 << 21
#: Groups up to this size are compared all at once, larger ones row by row.
FEW = 8
SEED = 42
_ODDS = mix(np.arange(1, BANDS * PER_BAND + 1, dtype=U64)) | U64(1)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` lower-cased words, ascending; a shorter text is one run, no words none."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros(0, "<u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(width, len(words)) - 1:].tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8"))


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set, none for an empty one: for each band its number and three minima over multiplied hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_ODDS), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[i:i + (1 << 12), None] * _ODDS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=U64)
    for column in least.reshape(BANDS, PER_BAND).T:
        keys = mix(keys * U64(0x9E3779B97F4A7C15) ^ column)
    return keys.view(np.int64)


def sketches(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            rows = []
            for text in texts(piece.column("text")):
                h = shingles(text)
                bits = int(np.array([simhash(h)], np.uint64).view(np.int64)[0])
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), bits, len(h), band_keys(h)))
            made = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *made], [*names, "key", "simhash", "n", "bands"])

    return run


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        found = [shingles(t).tobytes() for t in texts(piece.column("text"))]
        yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(found, pa.binary())], ["key", "hashes"])


def by_tile(run: Callable[[pa.Table], np.ndarray], few: Callable[[pa.RecordBatch, np.ndarray], np.ndarray] | None = None):
    """``run`` on the rows of each tile, which arrive together; gives pairs of row numbers. ``few``: on all small tiles of a batch."""

    def pairs(table: pa.Table | pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        key = table.column("key")
        key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
        return pa.RecordBatch.from_arrays([key.take(pa.array(side)) for side in rows], ["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            whole, held = split(table)
            yield from done(whole)
        if held is not None:
            yield from done(held)

    def starts(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy() for c in TILE])
        return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))

    def split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        last = int(starts(table)[-1])
        return table.slice(0, last), table.slice(last)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        first = starts(table)
        sizes = np.diff(np.append(first, table.num_rows))
        if few is not None:
            yield pairs(table, few(table, np.repeat(np.where(sizes <= FEW, np.arange(len(first)), -1), sizes)))
        for a, n in zip(first.tolist(), sizes.tolist()):
            if n > FEW or few is None and n > 1:
                part = table.slice(a, n)
                yield pairs(part, run(part))

    return over


def in_reach(bits: np.ndarray, n: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Whether fingerprints are within the radius and sizes can belong to sets of similarity 0.8."""
    return (np.bitwise_count(bits[i] ^ bits[j]) <= RADIUS) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))


def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    side, bits, n = (table.column(c).to_numpy() for c in ("side", "simhash", "n"))
    return side, np.ascontiguousarray(bits).view(np.uint64), n


def small_tiles(table: pa.Table, tile: np.ndarray) -> np.ndarray:
    """All candidate pairs of tiles of a few rows; -1 marks rows of larger ones. A tile this small is never split."""
    _, bits, n = columns(table)
    found = [np.zeros((2, 0), np.int64)]
    for d in range(1, FEW):
        i = np.flatnonzero((tile[:-d] == tile[d:]) & (tile[d:] >= 0)) if len(tile) > d else np.zeros(0, np.int64)
        i = i[in_reach(bits, n, i, i + d)]
        found.append(np.stack([i, i + d]))
    return np.concatenate(found, axis=1)


def forest(table: pa.Table, similar: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """A spanning forest of the links within a tile (side 2) or between two (sides 0 and 1): fewer links than rows.

    ``similar`` names, of candidates for a row, those that are links; all are where it is not given.
    """
    side, bits, n = columns(table)
    ones = np.bitwise_count(bits).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    within = bool(side[0] == 2)
    left, right = (order, order) if within else (order[side[order] == 0], order[side[order] == 1])
    heights, label, found = ones[right], np.arange(len(bits)), []
    for k, i in enumerate(left.tolist()):
        low, high = np.searchsorted(heights, [ones[i] - RADIUS, ones[i] + RADIUS + 1])
        hit = right[max(low, k + 1) if within else low:high]
        hit = hit[label[hit] != label[i]]
        hit = hit[in_reach(bits, n, i, hit)]
        if similar is not None and len(hit):
            hit = hit[similar(i, hit)]
        if len(hit):
            others, at = np.unique(label[hit], return_index=True)
            found.append(np.stack([np.full(len(at), i), hit[at]]))
            label[np.isin(label, others)] = label[i]
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def verified(table: pa.Table) -> np.ndarray:
    """The forest of pairs with shared / (n + m - shared) >= 4 / 5, counted on the sets, in whole numbers."""
    hashes = [np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()]
    sizes = np.array([len(h) for h in hashes], np.int64)
    ends = np.cumsum(sizes)
    token = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    present = np.zeros(int(token.max(initial=0)) + 1, bool)

    def similar(i: int, hit: np.ndarray) -> np.ndarray:
        mine = token[ends[i] - sizes[i]:ends[i]]
        present[mine] = True
        first = np.cumsum(sizes[hit]) - sizes[hit]
        places = np.arange(int(sizes[hit].sum())) + np.repeat(ends[hit] - sizes[hit] - first, sizes[hit])
        shared = np.add.reduceat(present[token[places]].astype(np.int64), first)
        present[mine] = False
        return 9 * shared >= 4 * (sizes[i] + sizes[hit])

    return forest(table, similar)


#: A tile or a pair of tiles: of a group the salts of its two parts.
TILE = ["group", "low", "high"]


def tiled(rows: DataFrame) -> DataFrame:
    """Rows (group, salts, key, ...) in every pair of parts of their group that they belong to, the rows of a tile together."""
    salt = F.pmod(F.xxhash64("key"), F.col("salts")).alias("salt")
    rows = rows.select("*", salt).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("other"))
    side = F.when(F.col("salts") == 1, 2).when(F.col("salt") == F.col("other"), 2).when(F.col("salt") < F.col("other"), 0).otherwise(1)
    rows = rows.select("*", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), side.alias("side"))
    return rows.drop("salt", "other", "salts").repartition(*TILE).sortWithinPartitions(*TILE)


def candidates(classes: DataFrame, tile_rows: int) -> DataFrame:
    """(a, b): links whose components hold every pair in reach of each other that shares a min-hash key."""
    rows = materialize(classes.select("key", "simhash", "n", F.explode("bands").alias("group")), "bands")
    shared = rows.groupBy("group").count().where("count > 1").select("group", F.ceil(F.col("count") / tile_rows).alias("salts"))
    found = mapped(tiled(rows.join(shared, "group")), by_tile(forest, small_tiles), "a binary, b binary")
    return materialize(found.distinct(), "candidates")


def links(classes: DataFrame, held: DataFrame, tile_rows: int) -> DataFrame:
    """(node, root) of the components of verified links between ``classes`` (key, simhash, n, bands, first)."""
    pairs = candidates(classes, tile_rows)
    units = materialize(components(pairs), "units")
    rows = classes.select("key", "simhash", "n", "first").join(units.withColumnRenamed("node", "key"), "key")
    sizes = rows.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("salts"))
    need = rows.select("key", F.col("first.id").alias("rep"), F.col("first.tag").alias("rep_tag"))
    text = held.join(need, held.id.eqNullSafe(need.rep) & (held.tag == need.rep_tag)).select("key", "text").dropDuplicates(["key"])
    known = mapped(text, sets, "key binary, hashes binary")
    rows = rows.join(sizes, "root").join(known, "key").select(F.xxhash64("root").alias("group"), "salts", "key", "simhash", "n", "hashes")
    found = materialize(mapped(tiled(rows), by_tile(verified), "a binary, b binary"), "near")
    return materialize(components(found), "roots")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row of each group of near copies, linked directly or over others: the one with the smallest id (of repeated ids the
    first by its columns).

    All columns of ``docs`` are kept. Texts without words, null ones among them, are one group. A group in which every id is
    null keeps one row. An empty table stays empty. A text and its shingle hashes are held whole in a task.
    """
    names = docs.columns
    held = docs.select(F.struct(*names).alias("row"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"),
                       F.xxhash64(*[F.col(c) for c in names]).alias("tag"))
    kind = held.schema["id"].dataType.simpleString()
    found = materialize(mapped(held.select("id", "tag", "text"), sketches(["id", "tag"]),
                               f"id {kind}, tag long, key binary, simhash long, n long, bands array<long>"), "sketches")
    classes = materialize(found.groupBy("key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"),
        *[F.first(c).alias(c) for c in ("simhash", "n", "bands")]), "classes")
    roots = links(classes, held, tile_rows)
    chosen = (classes.join(roots, classes.key == roots.node, "left")
              .groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first")).select("first.id", "first.tag"))
    # (id, tag) names a row up to identical rows, of which one stays; texts are only shuffled again where there are some.
    kept = held.join(chosen, held.id.eqNullSafe(chosen.id) & (held.tag == chosen.tag), "left_semi")
    if found.groupBy("id", "tag").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "tag"])
    return kept.select("row.*")
