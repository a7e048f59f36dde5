"""The prefix trie of conversations that are rebuilt from the head of another conversation and a rest of their own.

Fingerprints of turn sequences form a monoid: (length, sum of t_i * B^i) with a number t_i for the content of turn i, modulo three
primes below 2^31; a sequence followed by another is (n + m, s + B^n * t). Prefixes of every conversation come from one
distributed scan. A rebuilt prefix is a head of the base and a piece of the own turns; its fingerprint follows from three stored
prefixes, (own[d] - own[h]) * B^(k - h) + base[k], so that no rebuilt text exists anywhere. Turns travel as SHA-256 digests of
role and text, the references by which groups are verified: all members of a node must have the same last digest and the same
parent fingerprint, or the job is repeated with another base.

Subtrees need no walk. A node belongs to its smallest member, whose own nodes are the end of its path. So a sum over a subtree
is the sum, over the members, of what their own nodes hold, less the part of the owner's nodes above. Both are aggregations;
prefix sums along a conversation are distributed scans again, so a conversation or a node may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import constants, mapped
from actuspark.session import materialize

#: The three largest primes below 2^31: 93 bits.
PRIMES = (2147483647, 2147483629, 2147483587)
LANES = range(len(PRIMES))
STRIDE, HEADS = 20, 4
#: Ids of a joined piece of a node's list.
PIECE = 4096


def bases(seed: int) -> list[int]:
    digest = hashlib.sha256(f"base {seed}".encode()).digest()
    return [int.from_bytes(digest[8 * i:8 * i + 8], "big") % (p - 2) + 2 for i, p in enumerate(PRIMES)]


def scanned(seed: int):
    """Rows of a block, ordered by conversation: their place in the block's part of it and the fingerprint sums before and after."""
    multipliers = bases(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, sums = None, 0, [0] * len(PRIMES)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            group = np.cumsum(first) - 1
            begin = np.flatnonzero(first)
            at = np.arange(len(conv)) - begin[group]
            carried = conv[0] == now
            if carried:
                at[group == 0] += place
            made: list[pa.Array] = []
            for lane, p in enumerate(PRIMES):
                term = (digest[:, lane] % np.uint64(p)).astype(np.int64) * powers(multipliers[lane], at, p) % p
                # A running sum of a batch's terms stays below 2^63; groups start again from their own.
                total = np.cumsum(term)
                after = total - (total[begin] - term[begin])[group]
                if carried:
                    after[group == 0] += sums[lane]
                after %= p
                sums[lane] = int(after[-1])
                made += [pa.array((after - term) % p), pa.array(after)]
            now, place = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("block", "conv", "digest", "words")), pa.array(at.astype(np.int64)), *made],
                ["block", "conv", "digest", "words", "place", *(f"{x}{i}" for i in LANES for x in ("before", "after"))])

    return run


def powers(base: int, exponents: np.ndarray, p: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base % p, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % p, out)
        square, left = square * square % p, left >> 1
    return out


def added(total: Column, factor: Column, value: Column, p: int) -> Column:
    """total + factor * value modulo p; products of two remainders fit 64 bits."""
    return F.pmod(total + F.pmod(factor * value, F.lit(p)), F.lit(p))


def ordered_scan(rows: DataFrame, order: list[str], run, schema: str, label: str) -> DataFrame:
    """``run`` over blocks of a range partitioning by ``order``, each row with the number of its ``block``; written once."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    return materialize(mapped(placed, run, schema), label)


def carried(blocks: list, seed: int) -> list[tuple]:
    """Offsets (block, conv, place, sums) of blocks whose first conversation begins in an earlier one. One row a block is read."""
    out, now, place, sums = [], None, 0, [0] * len(PRIMES)
    multipliers = bases(seed)
    for b in blocks:
        if b["first"] == now:
            out.append((b["block"], now, place, *sums, *(pow(m, place, p) for m, p in zip(multipliers, PRIMES))))
        if b["last"]["conv"] != now or b["first"] != now:
            now, place, sums = b["last"]["conv"], 0, [0] * len(PRIMES)
        sums = [(s + pow(m, place, p) * b["last"][f"after{i}"]) % p for i, (s, m, p) in enumerate(zip(sums, multipliers, PRIMES))]
        place += b["last"]["place"] + 1
    return out


def turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv, place, digest, words, before0, after0, ...): every turn with its number and the fingerprint sums around it."""
    empty = F.lit("")
    role, text = (F.coalesce(F.col(c).cast("string"), empty) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(content, 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"))
    lanes = ", ".join(f"before{i} long, after{i} long" for i in LANES)
    found = ordered_scan(rows, ["conv", "turn", "digest", "tie"], scanned(seed),
                         f"block int, conv long, digest binary, words long, place long, {lanes}", "turns")
    last = F.max(F.struct("conv", "place", *[f"after{i}" for i in LANES])).alias("last")
    blocks = found.groupBy("block").agg(F.min("conv").alias("first"), last).orderBy("block").collect()
    moved = carried(blocks, seed)
    if not moved:
        return found.drop("block")
    names = {"block": pa.int32(), "conv": pa.int64(), "places": pa.int64(), **{f"{x}{i}": pa.int64() for x in ("sum", "power") for i in LANES}}
    held = found.join(F.broadcast(constants(found.sparkSession, moved, names)), ["block", "conv"], "left")
    shifted = [F.when(F.col("places").isNull(), F.col(c)).otherwise(added(F.col(f"sum{i}"), F.col(f"power{i}"), F.col(c), p)).alias(c)
               for i, p in enumerate(PRIMES) for c in (f"before{i}", f"after{i}")]
    return held.select("conv", (F.col("place") + F.coalesce("places", F.lit(0))).alias("place"), "digest", "words", *shifted)


def plans(held: DataFrame, seed: int) -> DataFrame:
    """One row a conversation: how many turns of its base (``k``) come before its own from place ``h`` on, and what that takes."""
    point = F.struct("digest", "words", *[f"{x}{i}" for x in ("before", "after") for i in LANES])
    convs = held.groupBy("conv").agg(F.count("*").alias("n"), *[
        F.max(F.when(F.col("place") == j, point)).alias(f"head{j}") for j in range(HEADS - 1)])
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"),
                        F.array_compact(F.array(*[f"head{j}" for j in range(HEADS - 1)])).alias("heads"))
    own = convs.withColumn("base", F.col("conv") - F.col("conv") % STRIDE).join(base, "base", "left")
    h = F.crc32(F.col("conv").cast("string")) % HEADS
    own = own.withColumn("h", h).withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = F.slice("heads", 1, F.col("k").cast("int"))
    cut = F.least("h", "n")  # own turns that are not used

    def at(array: Column, place: Column, lane: int) -> Column:
        return F.when(place > 0, F.get(array, (place - 1).cast("int"))[f"after{lane}"]).otherwise(0)

    mine = F.array(*[f"head{j}" for j in range(HEADS - 1)])
    factors = [[pow(pow(m, -1, p), j, p) for j in range(HEADS)] for m, p in zip(bases(seed), PRIMES)]
    values = [e.alias(f"{name}{i}") for i in LANES for name, e in (
        ("cut", at(mine, cut, i)), ("base", at(F.col("heads"), F.col("k"), i)),
        ("factor", F.element_at(F.array(*[F.lit(f) for f in factors[i]]), (F.col("h") - F.col("k") + 1).cast("int"))))]
    length = (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    return own.select("conv", "h", "k", length, F.when(F.col("k") > 0, heads).alias("heads"), *values)


def packed(name: str, lanes: list[Column]) -> list[Column]:
    """Two numbers for the three lanes of a fingerprint."""
    return [F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]).alias(f"{name}0"), lanes[2].alias(f"{name}1")]


def paths(held: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each conversation and depth: the fingerprints of this prefix (f) and of the one before (g), the last turn."""
    none = F.lit(None)
    root = plan.select("conv", F.lit(0).cast("long").alias("depth"), *packed("f", [F.lit(0).cast("long") for _ in LANES]),
                       *[none.cast("long").alias(f"g{j}") for j in range(2)], none.cast("binary").alias("digest"),
                       F.lit(0).cast("long").alias("words"), (F.col("length") == 0).alias("ends"))
    heads = plan.select("conv", "length", F.posexplode("heads").alias("place", "turn"))
    heads = heads.select("conv", (F.col("place") + 1).cast("long").alias("depth"), *[c for name, x in (("f", "after"), ("g", "before")) for c in packed(
        name, [F.col(f"turn.{x}{i}") for i in LANES])], "turn.digest", "turn.words", (F.col("place") + 1 == F.col("length")).alias("ends"))
    own = held.join(plan.drop("heads"), "conv").where("place >= h")
    depth = F.col("k") + F.col("place") - F.col("h") + 1
    lanes = {x: [added(F.col(f"base{i}"), F.col(f"factor{i}"), F.pmod(F.col(f"{x}{i}") - F.col(f"cut{i}"), F.lit(p)), p)
                 for i, p in enumerate(PRIMES)] for x in ("before", "after")}
    own = own.select("conv", depth.alias("depth"), *packed("f", lanes["after"]), *packed("g", lanes["before"]), "digest", "words",
                     (depth == F.col("length")).alias("ends"))
    return root.union(heads).union(own)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node, as pieces of its joined list of ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("depth", "f0", "f1")])
        conv = batch.column("conv").to_pylist()
        begin = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        cuts = np.unique(np.concatenate([begin, np.arange(0, len(conv), PIECE)])).tolist()
        rows = pa.array(cuts)
        pieces = [",".join(map(str, conv[a:b])) for a, b in zip(cuts, [*cuts[1:], len(conv)])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("depth", "f0", "f1", "conv")), pa.array(pieces)],
                                         ["depth", "f0", "f1", "conv", "piece"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which arrive in order."""
    now, state = None, None
    for batch in batches:
        done = []
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "f0", "f1", "piece"))):
            if key == now:
                state.update(b"," + piece.encode())
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(piece.encode())
        yield digests(done)
    if now is not None:
        yield digests([(*now, state.hexdigest())])


def digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                      ["depth", "f0", "f1", "ends_sha256"])


KEY = ["depth", "f0", "f1"]


def end_lists(path: DataFrame) -> DataFrame:
    """(depth, f0, f1, ends_sha256) of the nodes at which conversations end.

    A hash over an ordered list is one chain of steps. The rows are sorted and joined to pieces by range, however many share a
    node; only the pieces of a node then stream through one task, which keeps a hash state and nothing else.
    """
    order = [*KEY, "conv"]
    rows = path.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = mapped(rows, listed, "depth long, f0 long, f1 long, conv long, piece string")
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*order)
    return mapped(pieces, hashed, "depth long, f0 long, f1 long, ends_sha256 string")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``value`` over the rows before, inside a block's part of a conversation."""
    now, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, value = batch.column("conv_id").to_numpy(), batch.column("value").to_numpy()
        first = np.concatenate([[True], conv[1:] != conv[:-1]])
        begin, group = np.flatnonzero(first), np.cumsum(first) - 1
        after = np.cumsum(value)
        before = after - value - (after - value)[begin][group]
        if conv[0] == now:
            before[group == 0] += total
        now, total = conv[-1], int(before[-1] + value[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "conv_id", *KEY, "value")), pa.array(before)],
                                         ["block", "conv_id", *KEY, "value", "above"])


def above(nodes: DataFrame) -> DataFrame:
    """(depth, f0, f1, above): the values of the same owner's nodes at lesser depths."""
    value = (F.col("n_convs") - 1) * F.col("words")
    rows = nodes.select("conv_id", *KEY, value.alias("value"))
    found = ordered_scan(rows, ["conv_id", "depth"], summed, "block int, conv_id long, depth long, f0 long, f1 long, value long, above long", "above")
    blocks = found.groupBy("block").agg(F.min("conv_id").alias("first"), F.max(F.struct(
        "conv_id", "depth", (F.col("above") + F.col("value")).alias("total"))).alias("last")).orderBy("block").collect()
    moved, now, total = [], None, 0
    for b in blocks:  # one row a block
        if b["first"] == now:
            moved.append((b["block"], now, total))
        total = b["last"]["total"] + (total if b["first"] == now and b["last"]["conv_id"] == now else 0)
        now = b["last"]["conv_id"]
    if not moved:
        return found.select(*KEY, "above")
    names = {"block": pa.int32(), "conv_id": pa.int64(), "earlier": pa.int64()}
    held = found.join(F.broadcast(constants(nodes.sparkSession, moved, names)), ["block", "conv_id"], "left")
    return held.select(*KEY, (F.col("above") + F.coalesce("earlier", F.lit(0))).alias("above"))


def prefix_nodes(path: DataFrame) -> DataFrame | None:
    """The nodes with owner, members and last turn; None if a fingerprint stands for two different prefixes."""
    turn = F.struct("g0", "g1", "digest")
    nodes = materialize(path.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("g0").alias("g0"),
        F.max("g1").alias("g1"), F.min(turn).eqNullSafe(F.max(turn)).alias("one")), "nodes")
    return None if nodes.where("not one").limit(1).count() else nodes.drop("one")


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations ``conversations`` (conv_id, turn, role, text).

    Conversation c is the first h turns of conversation c - c % 20, h = crc32(c as text) % 4, all if that has fewer and none if it
    does not exist, then its own turns after its first h. A node is a distinct sequence of d such turns (role and text; null
    counts as empty): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, the hash of the ascending ids of the members that end there, joined by commas.

    Turns are ordered by ``turn``, null first; turns of equal number, repeated rows among them, all count, in the order of the
    digest of their content. Rows without a conv_id belong to no conversation. Without rows there are no nodes. Other columns
    don't matter. No text leaves the scan of the table; a task holds a batch of digests.
    """
    for attempt in range(seed, seed + 8):
        held = turns(conversations.select("conv_id", "turn", "role", "text"), attempt)
        path = materialize(paths(held, materialize(plans(held, attempt), "plans")), "paths")
        nodes = prefix_nodes(path)
        if nodes is not None:
            break
    else:
        raise RuntimeError("eight bases gave equal fingerprints to different prefixes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g0").alias("f0"), F.col("g1").alias("f1")).agg(
        F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")
    # What each conversation's own nodes hold, and whether it owns a leaf; then both over the members of each node.
    value = (F.col("n_convs") - 1) * F.col("words")
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum(value).alias("total"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sums = path.select("conv", *KEY).join(owned, "conv").groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select(F.col("depth").alias("up"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, KEY).join(above(nodes), KEY).join(end_lists(path), KEY, "left")
    out = out.withColumn("up", F.col("depth") - 1).join(parents, ["up", "g0", "g1"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      (F.col("total") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
