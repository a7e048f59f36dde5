"""Document fingerprints from closed syncmers.

A k-mer of bytes is chosen if the smallest hash among its inner s-mers is the first or the last of them. That depends on the
k-mer alone, not on its neighbours, so an edit changes only the anchors that it touches, and any anchor can be matched
wherever it stands. A fingerprint keeps the anchors with the smallest hashes, each with its place; two fingerprints are as
alike as the share of common anchors among the smallest of their union, counting only common anchors whose places differ by
the displacement that most of them agree on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import Rolling, constants, mapped, slices, sliding_min, texts

K, S = 16, 8
ANCHORS = 64
#: Places are kept in steps of this many bytes, and displacements may differ by one step.
STEP = 64
PIECE = 1 << 20
ENTRY = np.dtype([("hash", "<u4"), ("place", "<u4")])


def syncmers(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the closed syncmers of a byte array; ties go to the first, then the last inner s-mer."""
    if len(data) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolling = Rolling(data, 11)
    inner = rolling.every(s)
    smallest = sliding_min(inner, k - s + 1)
    n = len(data) - k + 1
    at = np.flatnonzero((inner[:n] == smallest) | (inner[k - s:] == smallest))
    return at, rolling.at(at, at + k)


def fingerprint(text: bytes) -> bytes:
    """The anchors with the smallest hashes, in their order; a text shorter than k has its whole as only anchor."""
    if not text:
        return b""
    data, best = np.frombuffer(text, np.uint8), np.zeros(0, ENTRY)
    if len(data) < K:
        best = np.zeros(1, ENTRY)
        best["hash"] = Rolling(data, 11).at(np.array([0]), np.array([len(data)])) >> np.uint64(32)
        return best.tobytes()
    for first in range(0, len(data) - K + 1, PIECE):
        at, hashes = syncmers(data[first: first + PIECE + K - 1])
        hashes, at = (hashes >> np.uint64(32)).astype(np.uint32), at + first
        if len(at) > 8 * ANCHORS:  # the first place of each of the smallest hashes is all that is kept
            few = hashes <= np.partition(hashes, 4 * ANCHORS)[4 * ANCHORS]
            if len(np.unique(hashes[few])) >= ANCHORS:
                hashes, at = hashes[few], at[few]
        entries = np.zeros(len(at), ENTRY)
        entries["hash"], entries["place"] = hashes, np.minimum(at // STEP, 2**32 - 1)
        entries = np.concatenate([best, entries])
        values, index = np.unique(entries["hash"].astype(np.uint32), return_index=True)
        best = entries[index[:ANCHORS]]
    return best.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: bottom-k estimate of the common share of anchors that one displacement explains; two empty texts are alike."""
    if a == b:
        return 1.0
    hashes = [np.frombuffer(t, ENTRY)["hash"].astype(np.uint32) for t in (a, b)]
    places = [np.frombuffer(t, ENTRY)["place"].astype(np.int64) for t in (a, b)]
    both, place = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(both, kind="stable")
    both, place = both[order], place[order]
    repeats = both[1:] == both[:-1]  # a hash of both, first that of a, then that of b
    number = np.arange(1, len(both)) - np.cumsum(repeats)  # place in the union of the row that follows
    common = np.flatnonzero(repeats & (number < ANCHORS))
    if not len(common):
        return 0.0
    shift = np.sort(place[common + 1] - place[common])
    longest = np.searchsorted(shift, shift, side="right") - np.searchsorted(shift, shift)
    agreed = shift[np.argmax(longest)]
    return float((np.abs(shift - agreed) <= 1).sum() / min(ANCHORS, len(both) - int(repeats.sum())))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ``fingerprint`` (hexadecimal; null and empty texts have the empty one) of each row; equal texts have equal ones."""
    base = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("text"))
    names = [f"carry_{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            found = [fingerprint(t).hex() for t in texts(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(found, pa.string())], [*names, "fingerprint"])

    kept = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in names)
    return mapped(base, run, f"{kept}, fingerprint string").withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


PAIRED = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its successor, over partitions sorted by (part, guest, id, tie); the guest row is only a successor."""
    held: tuple | None = None

    def row(one: tuple, other: tuple) -> dict:
        own, text, mark = one[1:]
        changed = edited(text, other[2])
        raw = changed.encode("utf-8", "surrogatepass")
        new = fingerprint(raw)
        return {"id": own, "n_chars": len(text), "edited_sha256": hashlib.sha256(raw).hexdigest(), "fingerprint": mark.hex(),
                "edited_fingerprint": new.hex(), "near_edited": likeness(mark, new), "near_next": likeness(mark, other[3])}

    for piece in slices(batches, "text"):
        out = []
        for part, guest, own, text in zip(*(piece.column(c).to_pylist() for c in ("part", "guest", "id", "text"))):
            text = text or ""
            one = (part, own, text, fingerprint(text.encode("utf-8", "surrogatepass")))
            if held is not None and held[0] == part:
                out.append(row(held, one))
            held = None if guest else one
        yield pa.RecordBatch.from_pylist(out, PAIRED)


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_rows: int = 4000, most_parts: int = 4096) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its second half replaced by the beginning of the next document by id, the last one's by that of the
    first. A range streams through its task, so at most ``most_parts`` ranges bound their number, not their memory. Texts cross the network once: ids are dealt to ranges of about ``part_rows`` rows, and each range gets the first
    row of the next one as a guest. Null ids come first; rows that share an id follow each other in the order of their texts'
    hashes (one range holds them all); a single row is its own successor; an empty table gives an empty result; other columns
    may have any names.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    total = base.count()
    parts = max(1, min(most_parts, total // part_rows))
    bounds = [] if parts == 1 else sorted({int(x) for x in base.where("id is not null").approxQuantile(
        "id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if x is not None})
    # Range 0 holds nulls and what lies before the first bound. The bounds are one number for each range.
    part = searched(bounds) if bounds else F.lit(0)
    rows = base.withColumn("part", part)
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("first")).collect()
    order = sorted(firsts, key=lambda r: r.part)
    guests = [(order[i].part, order[(i + 1) % len(order)].first["id"], order[(i + 1) % len(order)].first["tie"]) for i in range(len(order))]
    wanted = constants(base.sparkSession, guests, {"host": pa.int32(), "gid": pa.int64(), "gtie": pa.int64()})
    # One row for each range: bounded by the number of ranges, not by the data of any.
    heads = rows.join(F.broadcast(wanted), rows.id.eqNullSafe(wanted.gid) & (rows.tie == wanted.gtie)).groupBy("host").agg(
        F.first("id").alias("id"), F.first("text").alias("text"))
    all_rows = rows.select("part", F.lit(False).alias("guest"), "id", "text", "tie").union(
        heads.select(F.col("host").alias("part"), F.lit(True), "id", "text", F.lit(0).cast("long")))
    dealt = all_rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), "tie")
    out = mapped(dealt.select("part", "guest", "id", "text"), paired, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                               "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", doc_id)


def searched(bounds: list[int]):
    """The number of bounds that do not exceed the id, as a balanced tree of comparisons."""
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("id") < bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col("id").isNull(), 0).otherwise(tree(0, len(bounds)))
