"""SimHash fingerprints and their exact near-duplicate groups by tiled comparison.

Distinct fingerprints are compared in tiles with exclusive-or and bit counts; a pair of tiles is skipped when the population
counts of its two sides differ by more than the radius. A grid of all tiles would grow with the square of the documents, so a
tile holds only fingerprints that agree in one of ``radius + 1`` bit blocks: by the pigeonhole principle every pair within
the radius meets in one of them, and nothing is lost. A block value with more than ``tile_rows`` fingerprints is cut into
tiles of (population count, salt), and each admissible pair of its tiles is a group of its own, so that no task holds more
than two tiles. A pair of tiles emits only a spanning forest of its links, at most one for each fingerprint, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import mapped, slices, texts
from actuspark.llm.components import components
from actuspark.session import materialize

TILE_ROWS = 2048
SEED = 42  # fixed value of the fingerprint
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i:i + SHINGLES_AT_ONCE], stops[i:i + SHINGLES_AT_ONCE])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * counts > n).astype(object)).sum()) if (2 * counts > n).any() else 0


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``carry`` and ``simhash`` (the 64 bits as a signed long) of each row; null and empty texts have 0."""
    base = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("text"))
    names = [f"carry_{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            bits = np.array([fingerprint(t, shingle) for t in texts(piece.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(bits.view(np.int64))], [*names, "simhash"])

    kept = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in names)
    out = mapped(base, run, f"{kept}, simhash long")
    return out.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def forest(group: np.ndarray, side: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs within the radius in each group; side 0 is compared with side 1, side 2 with all.

    Rows are ordered by (group, population count). Row i is compared with row i + d for growing d, all groups at once, as long
    as some pair of that distance is in one group with population counts no further apart than the radius.
    """
    order = np.lexsort((np.bitwise_count(bits), group))
    group, side, bits = group[order], side[order], bits[order]
    ones = np.bitwise_count(bits).astype(np.int16)
    parent = np.arange(len(bits))
    active, d = np.arange(len(bits)), 0
    found: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    while len(active):
        d += 1
        active = active[active + d < len(bits)]
        other = active + d
        keep = (group[active] == group[other]) & (ones[other] - ones[active] <= radius)
        active, other = active[keep], other[keep]
        near = np.bitwise_count(bits[active] ^ bits[other]) <= radius
        near &= (side[active] != side[other]) | (side[active] == 2)
        for i, j in zip(active[near].tolist(), other[near].tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((i, j))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return bits[pairs[:, 0]], bits[pairs[:, 1]]


def compare(radius: int, at_once: int = 1 << 16):
    """Links within the groups of a partition that is sorted by group; whole groups are gathered up to ``at_once`` rows."""

    def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        a, b = forest(*(rows.column(c).to_numpy() for c in ("tile", "side")), rows.column("simhash").to_numpy().view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= at_once:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                tiles = rows.column("tile").to_numpy()
                cut = int(np.searchsorted(tiles == tiles[-1], True))  # the last group may go on in the next batch
                if cut:
                    yield linked([rows.slice(0, cut)])
                held = [rows.slice(cut)]
        if held:
            yield linked(held)

    return run


def block(bits: Column, index: int, blocks: int) -> Column:
    width = -(-64 // blocks)
    return F.shiftrightunsigned(bits, index * width).bitwiseAND(F.lit((1 << min(width, 64 - index * width)) - 1))


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct ``simhash`` values: same components as all links."""
    blocks = radius + 1
    rows = distinct.select("simhash", F.posexplode(F.array(*[block(F.col("simhash"), i, blocks) for i in range(blocks)])).alias("block", "value"))
    rows = rows.withColumn("ones", F.bit_count("simhash"))
    sizes = rows.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(sizes, ["block", "value"]), "tiles")
    usual = rows.where(F.col("n") <= tile_rows).select(F.xxhash64("block", "value").alias("tile"), F.lit(2).alias("side"), "simhash")
    # Crowded values: tiles of (population count, salt), and a group for each pair of tiles whose counts are close enough.
    crowded = rows.where(F.col("n") > tile_rows)
    per_count = crowded.groupBy("block", "value", "ones").agg(F.count("*").alias("m"))
    per_count = per_count.withColumn("salts", F.ceil(F.col("m") / tile_rows).cast("int"))
    crowded = crowded.join(per_count.drop("m"), ["block", "value", "ones"]).withColumn(
        "salt", F.pmod(F.xxhash64("simhash"), F.col("salts")).cast("int"))
    tiles = per_count.select("block", "value", "ones", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = tiles.select("block", "value", F.explode(F.sequence(F.col("ones") - radius, F.col("ones"))).alias("ones"),
                          F.col("ones").alias("ones2"), F.col("salt").alias("salt2"))
    pairs = tiles.join(others, ["block", "value", "ones"]).where("ones < ones2 or salt <= salt2")
    pair = F.xxhash64("block", "value", "ones", "salt", "ones2", "salt2").alias("tile")
    same = (F.col("ones") == F.col("ones2")) & (F.col("salt") == F.col("salt2"))
    roles = pairs.select("block", "value", "ones", "salt", pair, F.when(same, 2).otherwise(0).alias("side")).union(
        pairs.where(~same).select("block", "value", F.col("ones2"), F.col("salt2"), pair, F.lit(1)))
    dense = crowded.join(roles, ["block", "value", "ones", "salt"]).select("tile", "side", "simhash")
    # Two groups whose 64-bit names agree would only be compared needlessly.
    return mapped(usual.union(dense).repartition("tile").sortWithinPartitions("tile"), compare(radius), "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3,
                tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, simhash, component_id): documents linked by at most ``radius`` differing bits, directly or over others.

    ``component_id`` is the smallest id reached, the own one included. Null and empty texts have fingerprint 0 and are linked
    like any other. Repeated rows come out as often as they come in; a null id stays null and is passed over when the smallest
    id is taken (null if there is no other). An empty table gives an empty result; other columns may have any names. A text is
    held whole in a task, its shingles in pieces. Crowded fingerprints cost a tile pair for each two tiles of close
    population counts; equal fingerprints are compared once.
    """
    prints = materialize(fingerprints(docs, text, (doc_id,), shingle).withColumnRenamed(doc_id, "id"), "prints")
    classes = prints.groupBy("simhash").agg(F.min("id").alias("least"))
    roots = components(links(classes.select("simhash"), radius, tile_rows))
    joined = classes.join(roots, classes.simhash == roots.node, "left").select(
        "simhash", "least", F.coalesce("root", "simhash").alias("root"))
    joined = materialize(joined, "classes")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(named, "root").select("simhash", "component_id")
    return prints.join(labels, "simhash").select(F.col("id").alias(doc_id), "simhash", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id (of repeated ids the first by its columns).

    All columns of ``docs`` are kept. A group in which every id is null keeps one row. An empty table stays empty.
    """
    names = docs.columns
    held = docs.select(F.struct(*names).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"),
                       F.xxhash64(*[F.col(c) for c in names]).alias("tag"))
    found = materialize(fingerprints(held, "text", ("id", "tag"), shingle), "prints")
    classes = found.groupBy("simhash").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"))
    classes = materialize(classes, "classes")
    roots = components(links(classes.select("simhash"), radius))
    chosen = (classes.join(roots, classes.simhash == roots.node, "left")
              .groupBy(F.coalesce("root", "simhash").alias("root")).agg(F.min("first").alias("first")).select("first.id", "first.tag"))
    # (id, tag) names a row up to identical rows, of which one stays; texts are only shuffled again where there are some.
    kept = held.join(chosen, held.id.eqNullSafe(chosen.id) & (held.tag == chosen.tag), "left_semi")
    if found.groupBy("id", "tag").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "tag"])
    return kept.select("row.*")
