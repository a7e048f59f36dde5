"""Repeated substrings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``threshold`` bytes, most significant digit first, and equal groups are exactly the
repeated windows. Three things keep the passes small:

* Pass 1 sorts *anchored* suffixes. In every window of ``threshold`` bytes the anchor is the place of the smallest k-gram hash
  within the first half (the last one on ties), so equal windows have equal anchors at equal offsets. The first digit is the
  ``threshold // 2`` bytes from the anchor; an anchor whose digit occurs once owns no repeated window and is dropped.
* The second digit of pass 1 is the whole stretch of the windows that an anchor owns. Stretches that are equal throughout have
  only repeated windows; one of them stays as a representative.
* Pass 2 sorts, window by window, what is left: stretches that share the first digit and differ somewhere.

Digits are compared as two independent 64-bit hashes, 128 bits together. Each pass sends sorted blobs of hashes to buckets
taken from the hash; a task first merges what is equal among its own rows, so a string that a third of all documents hold
reaches its bucket once per task. Answers go back by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import U64, Rolling, cover, mapped, runs, slices, sliding_min, text_key, texts
from actuspark.session import materialize

GRAM = 16
FLUSH_ROWS = 1 << 19
#: Asked entries that one bucket is to hold. Each bucket answers every text it knows, so their number follows the data alone.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 24
WORD_BYTES = 6  # of a usual word, for the number of buckets only

PACKET = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("body", pa.binary())])
ANSWER = pa.schema([("text_key", pa.binary()), ("copies", pa.int64()), ("body", pa.binary())])
ENTRY = np.dtype([("major", "<u8"), ("minor", "<u8"), ("doc", "<u4"), ("many", "u1")])


def anchors(data: np.ndarray, threshold: int, rolling: Rolling | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text, and the first and last start of the windows that each owns."""
    n_windows = len(data) - threshold + 1
    if n_windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    half = threshold // 2
    rolling = rolling or Rolling(data, 1)
    gram = min(GRAM, max(1, half // 2))
    span = half - gram + 1
    place = np.arange(len(data) - gram + 1, dtype=np.int64)
    low = (1 << 24) - 1
    if len(place) > low:  # places no longer fit beside the hash: anchors of pieces that overlap by a window's first half
        parts, first = [], 0
        while first < n_windows:
            last = min(n_windows, first + low - threshold)
            a, s, e = anchors(data[first: last + threshold - 1], threshold)
            parts.append((a + first, s + first, e + first))
            first = last
        return tuple(np.concatenate(x) for x in zip(*parts))
    keys = (rolling.every(gram) & U64(~low & (2**64 - 1))) | (U64(low) - place.astype(U64))
    best = (low - (sliding_min(keys, span)[:n_windows] & U64(low)).astype(np.int64))
    change = np.flatnonzero(np.diff(best)) + 1
    starts = np.concatenate([[0], change])
    return best[starts], starts, np.concatenate([change, [n_windows]]) - 1


BLANKS = np.frombuffer(b" \t\n\r\v\f", np.uint8)


def units(text: bytes, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What is sorted, bytes or hashes of the words between ASCII blanks, and the byte where each unit begins, with the end as last
    entry. Blanks belong to the word before them, those at the front to the first."""
    data = np.frombuffer(text, np.uint8)
    if not words:
        return data, np.arange(len(data) + 1)
    starts, ends = runs(~np.isin(data, BLANKS))
    places = np.append(starts, len(data))
    places[:1] = 0
    return Rolling(data, 2).at(starts, ends), places


def stretches(data: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(first digit, hash of the owned stretch, first start, last start) of each anchor of a text."""
    rolling = Rolling(data, 1)
    at, first, last = anchors(data, threshold, rolling)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, U64), first, last
    second = Rolling(data, 3)
    digit = rolling.at(at, at + threshold // 2)
    shape = (at - first).astype(U64) * U64(1 << 32) + (at - last).astype(U64)
    return digit, second.at(first, last + threshold) ^ (shape * U64(0x9E3779B97F4A7C15)), first, last


class Asker:
    """Collects (major, minor, document) entries of a task and sends them in packets."""

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.copies, self.parts, self.rows = buckets, [], [], [], 0
        self.seen: dict[bytes, int] = {}

    def is_new(self, key: bytes) -> bool:
        """Equal texts of a task are asked for once; their number goes along."""
        if key in self.seen:
            self.copies[self.seen[key]] += 1
            return False
        self.seen[key] = len(self.keys)
        self.keys.append(key)
        self.copies.append(1)
        return True

    def add(self, major: np.ndarray, minor: np.ndarray) -> None:
        """Entries of the document that came last."""
        entry = np.zeros(len(major), ENTRY)
        entry["major"], entry["minor"], entry["doc"] = major, minor, len(self.keys) - 1
        self.parts.append(entry)
        self.rows += len(entry)

    def packets(self, local_kind: int) -> Iterator[pa.RecordBatch]:
        """Bucket -1-x: answers known here and the copies of each text. Other buckets: one entry for each distinct string."""
        entries = np.concatenate(self.parts) if self.parts else np.zeros(0, ENTRY)
        entries = entries[np.lexsort((entries["doc"], entries["minor"], entries["major"]))]
        same = np.zeros(len(entries), bool)
        if len(entries):
            same[1:] = (entries["major"][1:] == entries["major"][:-1]) & (entries["minor"][1:] == entries["minor"][:-1])
        many = same.copy()
        many[:-1] |= same[1:]
        keys, copies = np.array(self.keys, dtype="S16"), np.array(self.copies, dtype=np.int64)
        out: list[tuple[int, bytes, bytes]] = []
        known = entries[many & same]
        for doc, part in groups(known["doc"], known):
            out.append((-1 - salt(keys[doc], self.buckets), padded(keys[doc]), answer(int(copies[doc]), local_kind, part["minor"])))
        for doc in np.setdiff1d(np.arange(len(keys)), known["doc"]):
            out.append((-1 - salt(keys[doc], self.buckets), padded(keys[doc]), answer(int(copies[doc]), local_kind, known["minor"][:0])))
        out += self.extra(entries, same, keys)
        single = entries[~same]
        single["many"] = many[~same]
        which = (single["major"] % U64(self.buckets)).astype(np.int64)
        for bucket, part in groups(which, single):
            docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
            out.append((int(bucket), b"".join(padded(k) for k in keys[docs]), shipped(part)))
        self.keys, self.copies, self.parts, self.rows, self.seen = [], [], [], 0, {}
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_pylist([dict(zip(PACKET.names, x)) for x in out[i:i + 2000]], PACKET)

    def extra(self, entries: np.ndarray, same: np.ndarray, keys: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """Further answers that are known in the task."""
        return []


def shipped(part: np.ndarray) -> bytes:
    """Entries column by column, about 18 bytes each instead of 21: a packet's documents mostly fit into two bytes, ``many`` is a bit."""
    width = 2 if not len(part) or part["doc"].max() < 1 << 16 else 4
    columns = (part["major"], part["minor"], part["doc"].astype(f"<u{width}"), np.packbits(part["many"].astype(bool)))
    return np.array([len(part), width], "<u4").tobytes() + b"".join(c.tobytes() for c in columns)


def arrived(body: bytes) -> np.ndarray:
    n, width = np.frombuffer(body, "<u4", 2).tolist()
    part = np.zeros(n, ENTRY)
    part["major"], part["minor"] = np.frombuffer(body, "<u8", 2 * n, 8).reshape(2, n)
    part["doc"] = np.frombuffer(body, f"<u{width}", n, 8 + 16 * n)
    part["many"] = np.unpackbits(np.frombuffer(body, np.uint8, offset=8 + (16 + width) * n), count=n)
    return part


def padded(key: bytes) -> bytes:
    return bytes(key).ljust(16, b"\0")


def salt(key: bytes, buckets: int) -> int:
    return int.from_bytes(padded(key)[:6], "big") % buckets


def groups(by: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(by, kind="stable")
    by, rows = by[order], rows[order]
    cuts = np.flatnonzero(np.diff(by)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(by)]])):
        if hi > lo:
            yield by[lo], rows[lo:hi].copy()


def answer(copies: int, kind: int, values: np.ndarray) -> bytes:
    """Copies of the text, then the kind of answer and its hashes."""
    return np.array([copies, kind], "<u8").tobytes() + np.unique(values).astype("<u8").tobytes()


REPEATED, COMPARE = 1, 2


def judge(first_pass: bool):
    """Answers of a bucket: which entries are repeated, and in the first pass which stretches have to be compared."""

    def run(table: pa.Table) -> pa.Table:
        # Packets are joined column by column: at most the bucket's entries are in memory, each string once for each task.
        found: list[tuple[bytes, int, bytes]] = []
        keys, parts = [], []
        for bucket, k, body in zip(*(table.column(c).to_pylist() for c in PACKET.names)):
            if bucket < 0:
                found.append((k, int(np.frombuffer(body, "<u8", 1)[0]), body[8:]))
            else:
                part = arrived(body)
                part["doc"] += len(keys)
                keys += [k[i:i + 16] for i in range(0, len(k), 16)]
                parts.append(part)
        if parts:
            found += [(k, 0, b) for k, b in verdicts(np.concatenate(parts), np.array(keys, dtype="S16"), first_pass)]
        merged: dict[tuple[bytes, bytes], list] = {}
        for k, copies, body in found:
            held = merged.setdefault((k, body[:8]), [0, []])
            held[0] += copies
            held[1].append(np.frombuffer(body[8:], "<u8"))
        rows = [(k, copies, kind + np.unique(np.concatenate(values)).tobytes()) for (k, kind), (copies, values) in merged.items()]
        return pa.Table.from_pylist([dict(zip(ANSWER.names, r)) for r in rows], ANSWER)

    return run


def verdicts(e: np.ndarray, keys: np.ndarray, first_pass: bool) -> Iterator[tuple[bytes, bytes]]:
    _, number = np.unique(keys, return_inverse=True)  # the same text from several tasks
    names = keys[np.unique(number, return_index=True)[1]]
    e["doc"] = number[e["doc"]]
    e = e[np.lexsort((e["doc"], e["minor"], e["major"]))]
    new_major = np.concatenate([[True], e["major"][1:] != e["major"][:-1]])
    new_minor = new_major | np.concatenate([[True], e["minor"][1:] != e["minor"][:-1]])
    group = np.cumsum(new_minor) - 1
    size = np.bincount(group) + np.bincount(group, weights=e["many"]).astype(np.int64)
    repeated = size[group] > 1
    kinds = [(REPEATED, repeated)]
    if first_pass:
        family = np.cumsum(new_major) - 1
        variants = np.bincount(family, weights=new_minor)[family] > 1
        unsettled = np.bincount(family, weights=~repeated)[family] > 0
        kinds.append((COMPARE, variants & unsettled & new_minor))
    for kind, which in kinds:
        part = e[which]
        for doc, rows in groups(part["doc"], part):
            yield padded(names[doc]), np.array([kind], "<u8").tobytes() + np.unique(rows["minor"]).astype("<u8").tobytes()


def first_pass(threshold: int, buckets: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(buckets)
        for piece in slices(batches, "text"):
            for key, text in zip(piece.column("text_key").to_pylist(), texts(piece.column("text"))):
                if asker.is_new(key):
                    digit, stretch, _, _ = stretches(units(text, words)[0], threshold)
                    asker.add(digit, stretch)
            if asker.rows >= FLUSH_ROWS:
                yield from asker.packets(REPEATED)
        yield from asker.packets(REPEATED)

    return run


def window_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Start and both hashes of every window of the given stretches."""
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]) if len(first) else np.zeros(0, np.int64)
    ends = starts + threshold
    return starts, Rolling(data, 4).at(starts, ends), Rolling(data, 5).at(starts, ends)


def answers_of(bodies: list[bytes]) -> dict[int, np.ndarray]:
    out: dict[int, list[np.ndarray]] = {REPEATED: [], COMPARE: []}
    for body in bodies:
        out[int(np.frombuffer(body, "<u8", 1)[0])].append(np.frombuffer(body[8:], "<u8"))
    return {k: np.unique(np.concatenate(v)) if v else np.zeros(0, U64) for k, v in out.items()}


def second_pass(threshold: int, buckets: int, words: bool):
    """Windows of the stretches to be compared; equal texts ask once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(buckets)
        for piece in slices(batches, "text"):
            columns = (piece.column("text_key").to_pylist(), texts(piece.column("text")), piece.column("bodies").to_pylist())
            for key, text, bodies in zip(*columns):
                if not asker.is_new(key):
                    continue
                data, _ = units(text, words)
                _, stretch, first, last = stretches(data, threshold)
                which = np.isin(stretch, answers_of(bodies)[COMPARE])
                _, major, minor = window_hashes(data, first[which], last[which], threshold)
                asker.add(major, minor)
                if asker.rows >= FLUSH_ROWS:
                    yield from asker.packets(REPEATED)
        yield from asker.packets(REPEATED)

    return run


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def spans(text: bytes, copies: int, bodies: list[bytes], windows: list[bytes], threshold: int,
          words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The removed runs of one text, in bytes."""
    data, places = units(text, words)
    n = len(data)
    if n < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if copies > 1:
        return places[:1], places[-1:]
    if not bodies:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, stretch, first, last = stretches(data, threshold)
    known = answers_of(bodies)
    whole = np.isin(stretch, known[REPEATED])
    lo, hi = [first[whole]], [last[whole] + threshold]
    if windows:
        open_ = np.isin(stretch, known[COMPARE]) & ~whole
        starts, _, minor = window_hashes(data, first[open_], last[open_], threshold)
        starts = starts[np.isin(minor, answers_of(windows)[REPEATED])]
        lo.append(starts)
        hi.append(starts + threshold)
    starts, ends = runs(cover(np.concatenate(lo), np.concatenate(hi), n))
    return places[starts], places[ends]


OWN = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                 ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
KEPT = pa.field("kept_text", pa.string())


def finish(threshold: int, passed: list[str], keep_text: bool, settle: bool, words: bool):
    """Results of each row. ``settle``: the first time, when rows with stretches to compare still wait (no result, if single)
    or answer for others (text and answers stay); the others need their text no more."""
    own = OWN.append(KEPT) if keep_text else OWN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            rows, stay = [], []
            raw = texts(piece.column("text"))
            windows = [None] * len(raw) if settle else piece.column("windows").to_pylist()
            for text, copies, bodies, more in zip(raw, piece.column("copies").to_pylist(), piece.column("bodies").to_pylist(), windows):
                stay.append(settle and any(b[0] == COMPARE for b in bodies))
                if stay[-1] and copies == 1:
                    rows.append((None,) * len(own))
                    continue
                lo, hi = spans(text, copies, bodies, more or [], threshold, words)
                kept = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)]))
                rows.append((len(text), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), lo.tolist(), hi.tolist(),
                             kept.decode("utf-8", "ignore") if keep_text else None))
            found = pa.RecordBatch.from_pylist([dict(zip(own.names, r)) for r in rows], own)
            columns, names = [*(piece.column(c) for c in passed), *found.columns], [*passed, *own.names]
            if settle:
                columns += [pa.array([t if k else None for t, k in zip(raw, stay)], pa.binary()).cast(pa.string()),
                            pa.array([b if k else None for b, k in zip(piece.column("bodies").to_pylist(), stay)], pa.list_(pa.binary())),
                            piece.column("text_key"), piece.column("copies")]
                names += ["text", "bodies", "text_key", "copies"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_spans(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), threshold: int = 400,
                   keep_text: bool = False, words: bool = False) -> DataFrame:
    """For each row: bytes, removed bytes and runs, SHA-256 of what is kept, and where the removed runs start and end.

    A byte is removed if a string of ``threshold`` bytes that covers it also starts elsewhere in any text, its own included.
    With ``words`` the threshold counts words: what is removed are words in runs of ``threshold`` words that also start elsewhere,
    whatever blanks lie between them, together with the blanks up to the next word.
    Null and empty texts have no bytes; texts shorter than ``threshold`` stay; of repeated rows each is a text of its own, so
    both lose everything; an empty table gives an empty result. Only the columns in ``carry`` are passed on (``keep_text`` adds
    ``kept_text``, what is left without characters that a cut splits), other columns may have any names. A task holds one text and its hashes at a time (about
    60 bytes for each of its bytes), and of the exchanged strings one bucket.
    """
    base = docs.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("text"))
    base = base.withColumn("text_key", text_key("text"))
    # An anchor stands for about a quarter of the threshold; the bytes of the texts give the number of buckets.
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = size // WORD_BYTES if words else size
    buckets = int(max(LEAST_BUCKETS, 1 + 4 * size // max(threshold, 1) // BUCKET_ROWS))
    asked = mapped(base.select("text_key", "text"), first_pass(threshold, buckets, words), "bucket long, keys binary, body binary")
    replies = asked.groupBy("bucket").applyInArrow(judge(True), "text_key binary, copies long, body binary")
    info = replies.groupBy("text_key").agg(F.sum("copies").alias("copies"), F.collect_list(
        F.when(F.octet_length("body") > 8, F.col("body"))).alias("bodies"))
    names = [f"carry_{i}" for i in range(len(carry))]
    out_type = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in names) + ", " + RESULT
    out_type += ", kept_text string" if keep_text else ""
    # Every text is in info. Most rows are settled here; only texts with something to compare are stored and read again.
    first = materialize(mapped(base.join(info, "text_key"), finish(threshold, names, keep_text, True, words),
                               f"{out_type}, text string, bodies array<binary>, text_key binary, copies long"), "repeats")
    again = mapped(first.where("bodies is not null").select("text_key", "text", "bodies"), second_pass(threshold, buckets, words),
                   "bucket long, keys binary, body binary")
    windows = (again.groupBy("bucket").applyInArrow(judge(False), "text_key binary, copies long, body binary")
               .where(F.octet_length("body") > 8).groupBy("text_key").agg(F.collect_list("body").alias("windows")))
    waiting = first.where("n_bytes is null").select(*names, "text_key", "copies", "text", "bodies").join(windows, "text_key", "left")
    done = first.where("n_bytes is not null")
    rest = mapped(waiting, finish(threshold, names, keep_text, False, words), out_type)
    return done.select(rest.columns).union(rest).withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})
