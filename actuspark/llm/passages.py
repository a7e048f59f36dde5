"""Near-duplicate passages by compact windows.

Tokens are shingles of five words. For each of ``HASHES`` hash functions the Cartesian tree over a document's token hashes
says which tokens are the minimum of some stretch of ``least`` tokens, and how far each may reach: the compact window (l, c, r)
stands for all stretches within l..r that hold c, and all of them share c's hash as min-hash signature. Two passages of
similarity 0.8 share a given signature with probability 0.8, so four functions miss one pair of 600, and longer passages hold
many pairs. Windows of one signature are joined: those that are equal as far as stretches of ``least`` tokens reach are one
class without comparison, and one representative of each further class is verified by the Jaccard similarity of the stretches.

The tree is built for all documents of a batch at once: sliding minima give its nodes, binary lifting over minima of doubling
widths their reach, which beyond ``least`` tokens is not needed. Windows travel as in the suffix sort: sorted blobs in buckets
of the signature, equal ones once for each task, answers by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import U64, Rolling, cover, mapped, mix, runs, slices, sliding_min, text_key
from actuspark.llm.components import components
from actuspark.llm.decontaminate import combined, words
from actuspark.llm.suffixes import (
    ANSWER, BUCKET_ROWS, COMPARE, FLUSH_ROWS, LEAST_BUCKETS, PACKET, REPEATED, Asker, arrived, groups, padded, salt,
)
from actuspark.session import materialize

SHINGLE, HASHES, SIMILARITY, LEAST_WORDS = 5, 4, 0.8, 50
LINK, NEAR, TEXT = 3, 4, 5
#: Contexts are larger than asked entries: so many times as many buckets. Signatures are odd, numbers of buckets have to be, too.
CONTEXT_BUCKETS = 5
PLACE_BITS = 24


class Windows:
    """The compact windows of all documents of a batch, by document."""

    def __init__(self, column: pa.Array, least: int):
        hashes, first = words(column)
        self.n_words, self.least, self.first = np.diff(first), least, first
        tokens = combined(hashes, SHINGLE)
        self.tokens = tokens
        place = np.arange(len(tokens), dtype=np.int64)
        doc = np.searchsorted(first, place, side="right") - 1
        inside = place + SHINGLE <= first[doc + 1]
        multiplier = 0x9E3779B97F4A7C15
        up, down = Rolling._power(multiplier, len(tokens) + 1)
        sums = np.zeros(len(tokens) + 1, U64)
        np.cumsum(mix(tokens) * up[: len(tokens)], out=sums[1:])
        parts = []
        for j in range(HASHES):
            value = mix(tokens + U64(0x632BE59BD9B4E019 * (j + 1) % 2**64)) | U64(1)
            c, lo, hi = self.nodes(np.where(inside, value, U64(0)), place)
            shape = (c - lo).astype(U64) * U64(1 << 32) + (hi - c).astype(U64)
            parts.append((c, lo, hi, value[c], mix((sums[hi + 1] - sums[lo]) * down[lo] + shape)))
        self.c, self.lo, self.hi, self.major, self.minor = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(self.c, kind="stable")
        self.c, self.lo, self.hi, self.major, self.minor = (x[order] for x in (self.c, self.lo, self.hi, self.major, self.minor))
        self.cuts = np.searchsorted(self.c, first)

    def nodes(self, value: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes whose window has ``least`` tokens, and their windows as far as those reach. Value 0 separates documents."""
        if len(value) < self.least:
            return (np.zeros(0, np.int64),) * 3
        # Equal hashes: the later one counts as smaller. Places repeat beyond 2^24 tokens, far out of a window's reach.
        low = (1 << PLACE_BITS) - 1
        key = (value & U64(2**64 - 1 - low)) | (U64(low) - (place & low).astype(U64))
        key[value == 0] = 0
        smallest = sliding_min(key, self.least)
        smallest = smallest[np.concatenate([[True], smallest[1:] != smallest[:-1]])]
        smallest = smallest[smallest > 0]
        if len(key) <= low:
            c = np.unique(low - (smallest & U64(low)).astype(np.int64))
        else:
            c = np.flatnonzero(np.isin(key, smallest))
        levels = [key]
        while 2 * (1 << len(levels)) <= 2 * self.least:
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        lo, hi = c.copy(), c.copy()
        for k in reversed(range(len(levels))):
            step, level = 1 << k, levels[k]
            at = np.clip(lo - step, 0, len(level) - 1)
            lo = np.where((lo - step >= 0) & (level[at] > key[c]), lo - step, lo)
            at = np.clip(hi + 1, 0, len(level) - 1)
            hi = np.where((hi + step < len(key)) & (level[at] > key[c]), hi + step, hi)
        reach = self.least - 1
        return c, np.maximum(lo, c - reach), np.minimum(hi, c + reach)

    def of(self, i: int) -> slice:
        return slice(self.cuts[i], self.cuts[i + 1])

    def context(self, which: np.ndarray) -> np.ndarray:
        """The tokens around each node as far as its window reaches, 32 bits each, 0 beyond; the node stands in the middle."""
        at = self.c[which][:, None] + np.arange(1 - self.least, self.least)[None, :]
        inside = (at >= self.lo[which][:, None]) & (at <= self.hi[which][:, None])
        near = (mix(self.tokens[np.clip(at, 0, len(self.tokens) - 1)]) >> U64(32)).astype(np.uint32) | np.uint32(1)
        return np.where(inside, near, np.uint32(0))


class PassageAsker(Asker):
    def extra(self, entries: np.ndarray, same: np.ndarray, keys: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """Links to the first document of the task that has an equal window."""
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(entries)))) if len(entries) else np.zeros(0, np.int64)
        rank = np.argsort(np.argsort(keys))
        names = np.sort(keys)
        return [(-1 - salt(names[d], self.buckets), padded(names[d]), body(0, LINK) + padded(names[r]))
                for d, r in zip(*forest(rank[entries["doc"]], rank[entries["doc"][head]], len(keys)))]


def distinct_of(x: np.ndarray) -> np.ndarray:
    """The different numbers, ascending. Sorting is several times quicker here than the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each of ``n`` nodes that the edges a-b link to a smaller one, directly or over others."""
    a, b = (x[a != b].astype(np.int64) for x in (a, b))
    edges = np.stack(np.divmod(distinct_of(np.minimum(a, b) * n + np.maximum(a, b)), max(n, 1)))
    label = np.arange(n)
    while True:
        least = np.minimum(label[edges[0]], label[edges[1]])
        after = label.copy()
        for end in (*edges, *label[edges]):
            np.minimum.at(after, end, least)
        after = after[after]
        if (after == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = after


def body(copies: int, kind: int) -> bytes:
    return np.array([copies, kind], "<u8").tobytes()


def ask(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = PassageAsker(buckets)
        for piece in slices(batches, "text"):
            found = Windows(piece.column("text"), least)
            for i, key in enumerate(piece.column("text_key").to_pylist()):
                if asker.is_new(key):
                    own = found.of(i)
                    asker.add(found.major[own], found.minor[own])
            if asker.rows >= FLUSH_ROWS:
                yield from asker.packets(REPEATED)
        yield from asker.packets(REPEATED)

    return run


def judge(table: pa.Table) -> pa.Table:
    """Answers of a bucket: equal windows with a link to the first text that has one, and representatives to be compared."""
    found: list[tuple[bytes, int, bytes]] = []
    keys, parts = [], []
    for bucket, k, content in zip(*(table.column(c).to_pylist() for c in PACKET.names)):
        if bucket < 0:
            found.append((k, int(np.frombuffer(content, "<u8", 1)[0]), content[8:]))
        else:
            part = arrived(content)
            part["doc"] += len(keys)
            keys += [k[i:i + 16] for i in range(0, len(k), 16)]
            parts.append(part)
    if parts:
        e = np.concatenate(parts)
        names, number = np.unique(np.array(keys, dtype="S16"), return_inverse=True)
        e["doc"] = number[e["doc"]]
        e = e[np.lexsort((e["doc"], e["minor"], e["major"]))]
        new_major = np.concatenate([[True], e["major"][1:] != e["major"][:-1]])
        new_minor = new_major | np.concatenate([[True], e["minor"][1:] != e["minor"][:-1]])
        group = np.cumsum(new_minor) - 1
        repeated = (np.bincount(group) + np.bincount(group, weights=e["many"]).astype(np.int64))[group] > 1
        family = np.cumsum(new_major) - 1
        variants = np.bincount(family, weights=new_minor)[family] > 1
        for kind, which in ((REPEATED, repeated), (COMPARE, variants & new_minor)):
            for doc, rows in groups(e["doc"][which], e["minor"][which]):
                found.append((padded(names[doc]), 0, np.array([kind], "<u8").tobytes() + rows.tobytes()))
        head = e["doc"][np.flatnonzero(new_minor)[group]]
        for doc, root in zip(*forest(e["doc"], head, len(names))):
            found.append((padded(names[doc]), 0, np.array([LINK], "<u8").tobytes() + padded(names[root])))
    return merged(found)


def merged(found: list[tuple[bytes, int, bytes]]) -> pa.Table:
    """One row for each text and kind, its entries once each."""
    rows: dict[tuple[bytes, bytes], list] = {}
    for k, copies, content in found:
        held = rows.setdefault((k, content[:8]), [0, set()])
        held[0] += copies
        size = 16 if int.from_bytes(content[:8], "little") in (LINK, NEAR) else 8
        held[1].update(content[i:i + size] for i in range(8, len(content), size))
    out = [(k, copies, kind + b"".join(sorted(entries))) for (k, kind), (copies, entries) in rows.items()]
    return pa.Table.from_pylist([dict(zip(ANSWER.names, r)) for r in out], ANSWER)


def entries_of(bodies: list[bytes], kind: int, width: int = 1) -> np.ndarray:
    parts = [np.frombuffer(b[8:], "<u8") for b in bodies if int.from_bytes(b[:8], "little") == kind]
    return np.concatenate([np.zeros(0, "<u8"), *parts]).reshape(-1, width) if width > 1 else np.concatenate([np.zeros(0, "<u8"), *parts])


def context_type(least: int) -> np.dtype:
    return np.dtype([("major", "<u8"), ("minor", "<u8"), ("context", "<u4", (2 * least - 1,))])


def equal_spans(found: Windows, i: int, copies: int, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the passages of a document that the asked windows tell."""
    n = int(found.n_words[i])
    if n < found.least + SHINGLE - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if copies > 1:
        return np.array([0]), np.array([n])
    own = np.arange(len(found.c))[found.of(i)]
    own = own[np.isin(found.minor[own], entries_of(bodies, REPEATED))]
    return runs(cover(found.lo[own] - found.first[i], found.hi[own] + SHINGLE - found.first[i], n))


def send(least: int, buckets: int):
    """Contexts of the windows to be compared, one row for each text and bucket; under buckets below 0 what is known of each text.

    That is: words, number of spans, their starts and ends, then (window, place) of what is compared. Equal texts of a task are
    sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for piece in slices(batches, "text"):
            found, out = Windows(piece.column("text"), least), []
            for i, (key, copies, bodies) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("text_key", "copies", "bodies")))):
                if key in seen:
                    continue
                seen.add(key)
                start, end = equal_spans(found, i, copies, bodies)
                own = np.arange(len(found.c))[found.of(i)]
                own = own[np.isin(found.minor[own], entries_of(bodies, COMPARE))]
                places = np.stack([found.minor[own], (found.c[own] - found.first[i]).astype(U64)], axis=1).ravel()
                known = np.concatenate([np.array([found.n_words[i], len(start)], U64), start.astype(U64), end.astype(U64), places])
                aside = -1 - salt(key, buckets)
                out.append({"bucket": aside, "keys": key, "body": body(copies, TEXT) + known.tobytes()})
                out += [{"bucket": aside, "keys": key, "body": body(0, LINK) + b[8:]} for b in bodies if b[0] == LINK]
                own = own[np.unique(found.minor[own], return_index=True)[1]]
                rows = np.zeros(len(own), context_type(least))
                rows["major"], rows["minor"], rows["context"] = found.major[own], found.minor[own], found.context(own)
                for bucket, part in groups((rows["major"] % U64(buckets)).astype(np.int64), rows):
                    out.append({"bucket": int(bucket), "keys": key, "body": part.tobytes()})
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_pylist(out[k: k + 2000], PACKET)

    return run


def earlier(tokens: np.ndarray) -> np.ndarray:
    """For each place of each context the place before it that holds the same token, or -1."""
    order = np.argsort(tokens, axis=1, kind="stable")
    ordered = np.take_along_axis(tokens, order, 1)
    last = np.where(ordered[:, 1:] == ordered[:, :-1], order[:, :-1], -1)
    out = np.full(tokens.shape, -1, np.int64)
    np.put_along_axis(out, order[:, 1:], last, 1)
    return out


PAIRS_AT_ONCE = 2048
CANDIDATES_AT_ONCE = 1 << 18
#: Cells of the table of the leaders' tokens.
CELLS_AT_ONCE = 1 << 18
#: Pairs that were found alike and are held before only their classes stay.
MET_AT_ONCE = 1 << 20
#: Contexts of whole signatures that are compared at once; a signature of more is taken alone.
CONTEXTS_AT_ONCE = 1 << 13
#: Contexts that are compared at once after the leaders.
REST_AT_ONCE = 1 << 8


def counted(words: np.ndarray) -> np.ndarray:
    """How many of each column's words have a bit: (words, columns) to (columns, 64). Adders work on whole words, three at a time."""
    out, weight, n = np.zeros((words.shape[1], 64), np.uint8), 0, words.shape[1]
    while len(words):
        carries = [words[:0]]
        while len(words) > 1:
            k = len(words) // 3
            if k:
                x, y, z, rest = words[:k], words[k: 2 * k], words[2 * k: 3 * k], words[3 * k:]
                odd = x ^ y
                carries.append((x & y) | (odd & z))
                words = np.concatenate([odd ^ z, rest])
            else:
                carries.append(words[:1] & words[1:])
                words = words[:1] ^ words[1:]
        out += np.unpackbits(words[0].astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little") << np.uint8(weight)
        words, weight = np.concatenate(carries), weight + 1
    return out


def packed(flags: np.ndarray) -> np.ndarray:
    """Up to 64 flags of each row as one number."""
    wide = np.zeros((len(flags), 8), np.uint8)
    wide[:, : -(-flags.shape[1] // 8)] = np.packbits(flags, axis=1, bitorder="little")
    return wide.view("<u8")[:, 0]


class Contexts:
    """The contexts of a bucket by signature, and which of them hold a token.

    A stretch of ``least`` tokens around c has ``least // 2`` of them on one side of c. A similar stretch lacks ``lack`` of its
    tokens at most, none of them c's, so of that side's other rarest tokens, one more than these, it holds one. Those of either side are the probes of
    a context: whatever is alike to it holds a probe, and a line that many share is no probe unless nothing else is there.
    """

    def __init__(self, group: np.ndarray, contexts: np.ndarray, least: int):
        self.least, self.n = least, len(contexts)
        width = contexts.shape[1]
        token, row = contexts.ravel(), np.repeat(np.arange(self.n), width)
        order = np.argsort(group[row].astype(U64) << U64(32) | token, kind="stable")
        order = order[token[order] > 0]
        g, t, r = group[row[order]], token[order], row[order]
        new = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(t) != 0)])
        run = np.cumsum(new) - 1
        self.run = np.full(self.n * width, -1, np.int64)
        self.run[order] = run
        self.run = self.run.reshape(self.n, width)
        once = np.concatenate([[True], (np.diff(run) != 0) | (np.diff(r) != 0)])
        self.holders, self.many = r[once], np.bincount(run[once])
        self.begin = np.concatenate([[0], np.cumsum(self.many)])
        # Tokens that several contexts hold, numbered within their signature; a last number stands for all others.
        shared = self.many > 1
        of, number = g[new][shared], np.cumsum(shared) - 1
        self.names = np.searchsorted(of, group, side="right") - np.searchsorted(of, group)
        known = (self.run >= 0) & shared[self.run]
        name = np.where(known, number[self.run] - np.searchsorted(of, group)[:, None], self.names[:, None])
        # A place lies in the stretches from some offset to some offset; the last place of a token stands for all of them.
        place = np.arange(width)
        low, high = np.maximum(place - least + 1, 0).astype(U64), np.minimum(place, least - 1).astype(U64)
        inside = (U64(2) << high) - (U64(1) << low)
        before = earlier(contexts)
        last = contexts > 0
        row, at = np.nonzero(before >= 0)
        last[row, before[row, at]] = False
        masks = np.where(last, inside, U64(0))
        row, at = np.nonzero(last)
        back = at
        while len(row):
            back = before[row, back]
            row, at, back = (x[back >= 0] for x in (row, at, back))
            masks[row, at] |= inside[back]
        ends = (contexts[:, :least] > 0) & (contexts[:, least - 1:] > 0)
        self.masks, self.name = np.ascontiguousarray(masks.T), np.ascontiguousarray(name.T.astype(np.int32))
        self.distinct = counted(self.masks)
        # What a similar stretch has in common with one of so many tokens follows from the sum of both, and no stretch of the
        # signature has fewer than the fewest. Where not as many are held by another context too, nothing is similar.
        distinct, heads = self.distinct[:, :least].astype(np.int64), np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        fewest = np.minimum.reduceat(np.where(ends, distinct, width), heads)[np.cumsum(np.diff(group, prepend=group[0]) != 0)]
        need = np.maximum(SIMILARITY * distinct, SIMILARITY / (1 + SIMILARITY) * (distinct + fewest)) - 1e-9
        held = counted(np.where(self.name < self.names, self.masks, U64(0)))[:, :least]
        possible = ends & (held >= need)
        self.possible, self.lack = packed(possible), np.where(possible, distinct - need, 0).max(axis=1).astype(np.int64)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of contexts a bit for each offset at which their stretches, taken as sets, are similar enough.

        ``a`` is ascending: a table holds the masks of these contexts by token.
        """
        leader, of = np.unique(a, return_inverse=True)
        base = np.concatenate([[0], np.cumsum(self.names[leader] + 1)])
        table = np.zeros(base[-1], U64)
        masks, name = self.masks[:, leader], self.name[:, leader]
        place, i = np.nonzero((masks > 0) & (name < self.names[leader]))
        table[base[i] + name[place, i]] = masks[place, i]
        common = counted(table[base[of] + self.name.take(b, axis=1)] & self.masks.take(b, axis=1)).astype(np.int16)
        near = common >= SIMILARITY * (self.distinct[a].astype(np.int16) + self.distinct[b] - common)
        return packed(near) & self.possible[a] & self.possible[b]

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """(context, run) of the probes that another context holds too, by context."""
        none, middle, side = np.iinfo(np.int64).max, self.least - 1, self.least // 2
        many = self.lack[:, None] + 1
        found = []
        for part in (self.run[:, middle - side: middle], self.run[:, middle + 1: middle + 1 + side]):
            key = np.sort(np.where((part >= 0) & (part != self.run[:, middle, None]), self.many[part] << 40 | part, none), axis=1)
            key[:, 1:][key[:, 1:] == key[:, :-1]] = none
            key = np.sort(key, axis=1)
            usable = (part >= 0).all(axis=1)
            few = usable & ((key < none).sum(axis=1) < many[:, 0])
            row, at = np.nonzero((usable & ~few)[:, None] & (np.arange(side) < many))
            found.append((row, key[row, at] & ((1 << 40) - 1)))
            # A side of few tokens: all tokens of the context, c only where a stretch may hold nothing else.
            own = self.run[few, middle][:, None]
            same = self.run[few] == own
            row, at = np.nonzero((self.run[few] >= 0) & (~same | (same.sum(axis=1) >= self.least)[:, None]))
            found.append((np.flatnonzero(few)[row], self.run[few][row, at]))
        row, run = (np.concatenate(x) for x in zip(*found))
        several = self.many[run] > 1
        return np.divmod(np.unique(row[several] * len(self.many) + run[several]), max(len(self.many), 1))

    def candidates(self, row: np.ndarray, run: np.ndarray, turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leader, other) for the others that hold a probe of a leader.

        ``turn``: when a context was a leader, 0 for never. Of two that are alike each holds a probe of the other, so whoever was a
        leader in an earlier turn has met this one, and two of the same turn need to meet once.
        """
        size = np.cumsum(self.many[run])
        first = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
        block = (size[first] - self.many[run[first]]) // CANDIDATES_AT_ONCE
        for at in np.split(np.arange(len(row)), first[1:][np.diff(block) != 0]):
            many = self.many[run[at]]
            left = np.repeat(row[at], many)
            right = self.holders[np.repeat(self.begin[run[at]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
            fresh = (turn[right] == 0) | ((turn[right] == turn[left]) & (left < right))
            left, right = np.divmod(distinct_of(left[fresh] * self.n + right[fresh]), self.n)
            cells = np.cumsum(np.where(np.diff(left, prepend=-1) != 0, self.names[left] + 1, 0)) // CELLS_AT_ONCE
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.arange(1, len(left)) % PAIRS_AT_ONCE == 0)[: max(len(left) - 1, 0)]) + 1
            if len(left):
                yield from zip(np.split(left, cuts), np.split(right, cuts))


def alike(leaders: np.ndarray, others: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None, least: int) -> np.ndarray:
    """:meth:`Contexts.alike` of pairs given as rows of two arrays. ``before``, what ``earlier`` tells of both, is not needed."""
    pair = np.arange(len(leaders))
    held = Contexts(np.repeat(pair, 2), np.stack([leaders, others], axis=1).reshape(2 * len(pair), -1), least)
    return held.alike(2 * pair, 2 * pair + 1)


def verify(least: int):
    """Compare the contexts of each signature, first with leaders: the first that no leader was alike becomes the next one.

    A leader is compared with all contexts of its signature that hold one of its probes, leaders or not. Each round takes all
    contexts that come first among the open holders of their probes, all signatures of the bucket at once. Two contexts that
    different leaders met may be alike all the same, and one may be alike at more offsets than its leader told: so every context
    whose offsets are not all known, and every one outside the largest class of its signature, is compared with all holders of its
    probes too. Left out are only pairs of one class that can learn no more offsets.
    """

    def families(rows: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([[0], np.diff(rows["major"]) != 0]))

    def run(table: pa.Table) -> pa.Table:
        keys, parts, aside = [], [], []
        for bucket, k, content in zip(*(table.column(c).to_pylist() for c in PACKET.names)):
            if bucket < 0:
                aside.append((k, int(np.frombuffer(content, "<u8", 1)[0]), content[8:]))
                continue
            parts.append(np.frombuffer(content, context_type(least)))
            keys += [k] * len(parts[-1])
        if not parts:
            return pa.Table.from_pylist([dict(zip(ANSWER.names, r)) for r in aside], ANSWER)
        rows, names = np.concatenate(parts), np.array(keys, dtype="S16")
        order = np.lexsort((names, rows["minor"], rows["major"]))
        order = order[np.concatenate([[True], (np.diff(rows["major"][order]) != 0) | (np.diff(rows["minor"][order]) != 0)])]
        family = families(rows[order])
        ends = np.searchsorted(family, np.arange(family[-1] + 1), side="right")
        block = (ends - 1) // CONTEXTS_AT_ONCE
        cuts = [0, *ends[:-1][np.diff(block) != 0], len(order)]
        links: set[tuple[bytes, bytes]] = set()
        found = [x for a, b in zip(cuts, cuts[1:]) for x in answers(rows[order[a:b]], names[order[a:b]], links)]
        ends, at = np.unique(np.array(list(links), dtype="S16").ravel(), return_inverse=True)
        for node, root in zip(*forest(*at.reshape(-1, 2).T, len(ends))):
            found.append((padded(ends[node]), 0, np.array([LINK], "<u8").tobytes() + padded(ends[root])))
        return pa.concat_tables([merged(found), pa.Table.from_pylist([dict(zip(ANSWER.names, r)) for r in aside], ANSWER)])

    def answers(rows: np.ndarray, names: np.ndarray, links: set[tuple[bytes, bytes]]) -> list[tuple[bytes, int, bytes]]:
        held = Contexts(families(rows), rows["context"], least)
        rows, names = rows[held.possible > 0], names[held.possible > 0]
        if not len(rows):
            return []
        family = families(rows)
        held = Contexts(family, rows["context"], least)
        row, probe = held.probes()
        if not len(row):
            return []
        # Holders of the probes only, closed ones as n.
        probed, at = np.unique(probe, return_inverse=True)
        sizes = held.many[probed]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        holders = held.holders[np.repeat(held.begin[probed] - starts, sizes) + np.arange(sizes.sum())]
        open_, bits = np.zeros(len(rows), bool), np.zeros(len(rows), U64)
        open_[row] = True
        first = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
        # A class is joined over contexts of one signature only, and over equal texts.
        known, text = np.unique(names, return_inverse=True)
        nodes, node = np.unique(family * len(known) + text, return_inverse=True)
        met: list[np.ndarray] = []
        turn = np.zeros(len(rows), np.int64)

        def joined() -> np.ndarray:
            """(node, root) of all that were found alike so far."""
            met[:] = [np.stack(forest(*np.concatenate([np.zeros((2, 0), np.int64), *met], axis=1), len(nodes)))]
            return met[0]

        def compare(chosen: np.ndarray) -> Iterator[np.ndarray]:
            for a, b in held.candidates(row[chosen], probe[chosen], turn):
                near = held.alike(a, b)
                a, b, near = (x[near > 0] for x in (a, b, near))
                np.bitwise_or.at(bits, a, near)
                np.bitwise_or.at(bits, b, near)
                met.append(np.stack([node[a], node[b]]))
                if len(met) > MET_AT_ONCE // PAIRS_AT_ONCE:
                    joined()
                yield b

        while open_.any():
            least_open = np.minimum.reduceat(np.where(open_[holders], holders, len(rows)), starts)
            ahead = np.minimum.reduceat(least_open[at], first)
            leader = row[first][open_[row[first]] & (ahead >= row[first])]
            open_[leader] = False
            turn[leader] = turn.max() + 1
            for other in compare(np.isin(row, leader)):
                open_[other] = False
        root = np.arange(len(nodes))
        child, parent = joined()
        root[child] = parent
        classes, number, size = np.unique(np.stack([family, root[node]]), axis=1, return_inverse=True, return_counts=True)
        order = np.lexsort((size, classes[0]))
        largest = order[np.flatnonzero(np.append(np.diff(classes[0][order]) != 0, True))]
        outside = ~np.isin(number, largest)
        while True:
            rest = np.zeros(len(rows), bool)
            rest[row] = True
            rest = np.flatnonzero(rest & (turn == 0) & (outside | (bits != held.possible)))
            if not len(rest):
                break
            # Each batch tells offsets of others too, which then need no comparison of their own.
            ahead = rest[:: len(rest) // REST_AT_ONCE + 1]
            turn[ahead] = turn.max() + 1
            for _ in compare(np.isin(row, ahead)):
                pass
        ends = known[nodes[joined()] % len(known)]
        links.update((x, y) for x, y in zip(*ends.tolist()) if x != y)
        kind = np.array([NEAR], "<u8").tobytes()
        return [(padded(names[i]), 0, kind + rows["minor"][i].tobytes() + bits[i].tobytes()) for i in np.flatnonzero(bits)]

    return run


def spans(bodies: list[bytes], least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text, first and last word (exclusive) of its near-duplicate passages."""
    known = next(np.frombuffer(b[8:], "<u8") for b in bodies if b[0] == TEXT)
    n, k = int(known[0]), int(known[1])
    lo, hi = [known[2: 2 + k].astype(np.int64)], [known[2 + k: 2 + 2 * k].astype(np.int64)]
    windows, near = known[2 + 2 * k:].reshape(-1, 2), entries_of(bodies, NEAR, 2)
    if len(near):
        near = near[np.argsort(near[:, 0])]
        at = np.minimum(np.searchsorted(near[:, 0], windows[:, 0]), len(near) - 1)
        hit = near[at, 0] == windows[:, 0]
        which, offset = np.nonzero(near[at[hit], 1][:, None] >> np.arange(least, dtype=U64)[None, :] & U64(1))
        lo.append(windows[hit, 1].astype(np.int64)[which] + 1 - least + offset)
        hi.append(lo[-1] + least + SHINGLE - 1)
    return n, *runs(cover(np.concatenate(lo), np.concatenate(hi), n))


def finish(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            found = [spans(bodies, least) for bodies in piece.column("bodies").to_pylist()]
            columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([int((b - a).sum()) for _, a, b in found], pa.int64()),
                       pa.array([a.tolist() for _, a, _ in found], pa.list_(pa.int64())),
                       pa.array([b.tolist() for _, _, b in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([piece.column("text_key"), *columns], ["text_key", "n_words", "n_repeated", "starts", "ends"])

    return run


def is_kind(column: str, *kinds: int):
    return F.expr(f"hex(substring({column}, 1, 1)) in ({', '.join(repr(f'{k:02X}') for k in kinds)})")


def near_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_repeated, starts, ends, component_id) of each row: the words in near-duplicate passages.

    A passage is a run of words covered by stretches of ``least_words`` words whose shingles have a Jaccard similarity of 0.8 or
    more with a stretch elsewhere in any text, its own included. ``component_id`` is the smallest id of the documents linked by
    such passages, directly or over others; a document without passages is alone. Words are those of the decontamination
    operator. Null, empty and short texts have no passage; repeated rows and equal texts of ``least_words`` words are passages
    as a whole; a null id stays null where it is alone and is passed over otherwise. An empty table gives an empty result;
    other columns may have any names. ``least_words`` is at most 68, a stretch's offsets have to fit into 64 bits.
    """
    least = least_words - SHINGLE + 1
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("text_key", text_key("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(max(LEAST_BUCKETS, 1 + HASHES * size // (3 * least) // BUCKET_ROWS)) | 1
    packet, reply = "bucket long, keys binary, body binary", "text_key binary, copies long, body binary"
    asked = mapped(base.select("text_key", "text"), ask(least, buckets), packet)
    replies = asked.groupBy("bucket").applyInArrow(judge, reply)
    info = replies.groupBy("text_key").agg(F.sum("copies").alias("copies"), F.collect_list(
        F.when(F.octet_length("body") > 8, F.col("body"))).alias("bodies"))
    sent = mapped(base.select("text_key", "text").join(info, "text_key").select("text_key", "text", "copies", "bodies"),
                  send(least, CONTEXT_BUCKETS * buckets), packet)
    near = materialize(sent.groupBy("bucket").applyInArrow(verify(least), reply), "near")
    bodies = near.where(is_kind("body", TEXT, NEAR)).groupBy("text_key").agg(F.collect_list("body").alias("bodies"))
    by_text = mapped(bodies, finish(least), "text_key binary, n_words long, n_repeated long, starts array<long>, ends array<long>")
    found = materialize(base.select("id", "text_key").join(by_text, "text_key"), "found")
    pairs = near.where(is_kind("body", LINK)).select(F.hex("text_key").alias("a"), F.explode(F.expr(
        "transform(sequence(9, octet_length(body) - 15, 16), i -> hex(substring(body, i, 16)))")).alias("b"))
    roots = components(pairs)
    # The smallest id of each text, then of each component: combined before they are shuffled.
    texts = found.where("n_repeated > 0").groupBy(F.hex("text_key").alias("node")).agg(F.min("id").alias("least"))
    texts = materialize(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "texts")
    named = texts.join(texts.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = found.withColumn("node", F.when(F.col("n_repeated") > 0, F.hex("text_key"))).join(named, "node", "left")
    return out.select(F.col("id").alias(doc_id), "n_words", "n_repeated", "starts", "ends",
                      F.when(F.col("n_repeated") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
