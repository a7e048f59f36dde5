"""Distributed ordering: global ranks, running totals, equal-frequency bins and exact quantiles.

A window without partition keys would put all rows in one task. Here rows are range-partitioned on a *unique*
sort key, numbered inside each block, and written once to the checkpoint folder; a tiny per-block table then
supplies the offsets. Ties and hot groups are split between blocks because the sort key always ends in a unique
column. Rank-only operators need no second shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actuspark.session import materialize, small_table

BLOCK, POS = "_block", "_pos"
POS_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def ordered_blocks(df: DataFrame, order: Sequence[Column], label: str = "ordered") -> DataFrame:
    """Range-partition on ``order`` (unique over the table) and number the rows of each block from 0."""
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = placed.select(
        *df.columns,
        F.shiftright("_row", POS_BITS).cast("int").alias(BLOCK),
        F.col("_row").bitwiseAND(F.lit((1 << POS_BITS) - 1)).alias(POS),
    )
    return materialize(placed, label)


def _with_offsets(blocks: DataFrame, group: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Attach, to every row, the totals of the earlier blocks of its group and its group's first position here."""
    per_block = blocks.groupBy(*group, BLOCK).agg(
        F.min(POS).alias("_first"), *[c.alias(f"_t_{name}") for name, c in totals.items()])
    earlier = W.partitionBy(*group).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col(BLOCK).alias("_g_block"), "_first",
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in totals],
    )
    # one row per block plus one per group change; without groups the number of blocks bounds it
    offsets = small_table(offsets) if group else F.broadcast(offsets)
    on = F.col(BLOCK) == F.col("_g_block")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return blocks.join(offsets, on)


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank", group: Sequence[str] = (),
                keep_blocks: bool = False) -> DataFrame:
    """Row number over the whole table, or within ``group``, along ``order``, which must end in a unique key."""
    blocks = ordered_blocks(df, [*[F.col(g) for g in group], *order], "ranked")
    placed = _with_offsets(blocks, group, {"n": F.count(F.lit(1))})
    extra = [BLOCK, POS] if keep_blocks else []
    return placed.select(
        *df.columns, (F.col("_o_n") + F.col(POS) - F.col("_first") + 1).cast("bigint").alias(rank), *extra)


def running_totals(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str],
                   group: Sequence[str] = ()) -> DataFrame:
    """Running sums (current row included) of ``{output: input column}`` along a unique ``order`` within ``group``.

    Meant for tables already aggregated to one row per sort key.
    """
    blocks = ordered_blocks(df, [*[F.col(g) for g in group], *order], "running")
    placed = _with_offsets(blocks, group, {out: F.sum(c) for out, c in sums.items()})
    inside = W.partitionBy(*group, BLOCK).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    return placed.select(
        *df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{out}")).alias(out) for out, c in sums.items()])


def bin_of_rank(rank: str, n: str, bins: int = 10) -> Column:
    """Equal-frequency bin of a rank, by the linear-interpolation cut rule (sizes differ from NTILE)."""
    last = f"greatest({n} - 1, 1)"
    return F.expr(f"cast(greatest(1, (({rank} - 1) * {bins} + {last} - 1) div {last}) as int)")


def equal_frequency_bins(df: DataFrame, order: Sequence[Column], bins: int = 10, out: str = "bin",
                         group: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """Number the rows of each group 1..``bins`` by rank along ``order`` (unique). ``rank`` keeps the rank too."""
    ranked = global_rank(df, order, "_rank", group)
    sized = attach(ranked, ranked.groupBy(*group).agg(F.max("_rank").alias("_n")), group)
    kept = [F.col("_rank").alias(rank)] if rank else []
    return sized.select(*df.columns, bin_of_rank("_rank", "_n", bins).alias(out), *kept)


def attach(df: DataFrame, per_group: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add the columns of a one-row-per-group table to every row of its group."""
    if not group:  # a single row: plain constants
        row = per_group.first()
        return df.select("*", *[F.lit(row[f.name] if row else None).cast(f.dataType).alias(f.name)
                                for f in per_group.schema.fields])
    return join_groups(df, small_table(per_group), group)


def join_groups(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """:func:`attach` for two tables that are both already aggregated: a plain lazy join, no size check needed."""
    if not group:
        return attach(left, right, ())
    renamed = right.select([F.col(c).alias(f"_k_{c}") if c in group else F.col(c) for c in right.columns])
    on = None
    for g in group:
        test = F.col(g).eqNullSafe(F.col(f"_k_{g}"))
        on = test if on is None else on & test
    return left.join(renamed, on, "left").drop(*[f"_k_{g}" for g in group])


def _positions(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str],
               brackets: DataFrame | None) -> DataFrame:
    """Values at the two order positions around each quantile, one row per (group, prob).

    With brackets, rows outside all of them collapse to one counted row per gap before anything is shuffled.
    """
    if brackets is None:
        sizes = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count(value).alias("_n"))
        rows = attach(df.filter(F.col(value).isNotNull()), sizes, group)
        keyed = rows.select(*group, "_n", F.col(value).cast("double").alias("_v"), F.lit(0).alias("_gap"))
    else:
        rows = attach(df.filter(F.col(value).isNotNull()), brackets, group)
        v = F.col(value).cast("double")
        key, gap = None, None
        for i in reversed(range(len(probs))):
            lo, hi = F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]
            key = F.when(v > hi, hi).when(v >= lo, v) if key is None else key.when(v > hi, hi).when(v >= lo, v)
            gap = F.when(v > hi, 1).when(v >= lo, 0) if gap is None else gap.when(v > hi, 1).when(v >= lo, 0)
        keyed = rows.select(
            *group, "_n", key.otherwise(F.lit(float("-inf"))).alias("_v"), gap.otherwise(F.lit(1)).alias("_gap"))
    counted = keyed.groupBy(*group, "_n", "_v", "_gap").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(counted, [F.col("_v"), F.col("_gap")], {"_upto": "_c"}, group)
    at = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(i).alias("_i"))
                             for i, p in enumerate(probs)])).alias("_at")
    hits = cum.select("*", at).select("*", "_at.prob", "_at._i").drop("_at")
    h = (F.col("_n") - 1) * F.col("prob")
    low = F.floor(h)
    high = F.least(low + 1, F.col("_n") - 1)
    covers = lambda k: (F.col("_upto") - F.col("_c") <= k) & (k < F.col("_upto"))
    hits = hits.filter(covers(low) | covers(high))
    return hits.groupBy(*group, "_i", "prob").agg(
        F.max(F.when(covers(low), F.col("_v"))).alias("_low"),
        F.max(F.when(covers(high), F.col("_v"))).alias("_high"),
        F.max(h - low).alias("_part"), F.max("_gap").alias("_missed"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
                    out: str = "quantile", accuracy: int = 10_000, single_pass_rows: int = 2_000_000) -> DataFrame:
    """Exact linearly interpolated quantiles: rows ``(group..., prob, out)``.

    Small inputs (checked by count) use the built-in exact percentile. Larger ones are bracketed by an approximate
    pass, so that only rows near a quantile are sorted; a bracket that misses its position triggers a full sort.
    """
    probs = [float(p) for p in probs]
    v = F.col(value).cast("double")
    df = df.filter(F.col(value).isNotNull())
    if df.count() <= single_pass_rows:
        exact = df.groupBy(*group).agg(F.percentile(v, F.lit(probs)).alias("_q"))
        rows = exact.select(*group, F.posexplode("_q").alias("_i", out)).select(
            *group, F.element_at(F.lit(probs), F.col("_i") + 1).alias("prob"), out)
        return rows.filter(F.col(out).isNotNull())
    step = 2.0 / accuracy
    marks = [m for p in probs for m in (max(p - step, 0.0), min(p + step, 1.0))]
    brackets = small_table(df.groupBy(*group).agg(
        F.count(v).alias("_n"), F.percentile_approx(v, F.lit(marks), accuracy).alias("_edges")).filter("_n > 0"))
    found = small_table(_positions(df, value, probs, group, brackets))
    if found.filter("_missed = 1").limit(1).count():
        found = small_table(_positions(df, value, probs, group, None))
    # The built-in's arithmetic, so that a value does not depend on the path taken.
    between = (1 - F.col("_part")) * F.col("_low") + F.col("_part") * F.col("_high")
    return found.select(*group, "prob", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias(out))


def quantile_value(df: DataFrame, value: str, prob: float, **options) -> float:
    """One quantile of the whole table, as a number."""
    row = exact_quantiles(df, value, [prob], **options).first()
    return None if row is None else float(row["quantile"])
