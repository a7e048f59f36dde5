"""Row-to-previous-row operators within a key, safe for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actuspark.operators.ranking import BLOCK, POS, ordered_blocks
from actuspark.session import small_table

HOT_KEY_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEY_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None. Map-side counting; at most rows / limit keys."""
    found = small_table(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(key))
    return None if found.isEmpty() else found


def _previous_by_window(df: DataFrame, key: str, order: Sequence[Column], values: Mapping[str, str]) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(out) for out, c in values.items()])


def _previous_by_blocks(df: DataFrame, key: str, order: Sequence[Column], values: Mapping[str, str]) -> DataFrame:
    """The same result by range partitions: windows run per block, block edges are bridged by a per-block table."""
    blocks = ordered_blocks(df, [F.col(key), *order], "sequence")
    carried = F.struct(F.col(key).alias("_key"), *[F.col(c).alias(out) for out, c in values.items()])
    tails = blocks.groupBy(BLOCK).agg(F.max_by(carried, POS).alias("_tail"))
    tails = tails.select(F.col(BLOCK).alias("_next"), F.lag("_tail").over(W.orderBy(BLOCK)).alias("_before"))
    inside = W.partitionBy(BLOCK).orderBy(POS)
    rows = blocks.select("*", F.lag(carried).over(inside).alias("_lag"))
    rows = rows.join(small_table(tails), F.col(BLOCK) == F.col("_next"), "left")
    before = F.when(F.col(POS) == 0, F.col("_before")).otherwise(F.col("_lag"))
    rows = rows.withColumn("_prev", F.when(before["_key"] == F.col(key), before))
    return rows.select(*df.columns, *[F.col(f"_prev.{out}").alias(out) for out in values])


def previous_values(df: DataFrame, key: str, order: Sequence[Column], values: Mapping[str, str],
                    hot_key_rows: int = HOT_KEY_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Values ``{output: input column}`` of the previous row of the same key along a unique ``order``.

    Keys up to ``hot_key_rows`` rows use an ordinary window; larger keys are split over range partitions.
    ``counted`` may name a cheaper table with at least as many rows per key for finding the large keys.
    """
    hot = hot_keys(df if counted is None else counted, key, hot_key_rows)
    if hot is None:
        return _previous_by_window(df, key, order, values)
    usual = df.join(hot, key, "left_anti")
    large = df.join(hot, key, "left_semi")
    return _previous_by_window(usual, key, order, values).unionByName(
        _previous_by_blocks(large, key, order, values))


def follow_ups(df: DataFrame, key: str, start: str, end: str, tie: Sequence[str], low: int = 0, high: int = 30,
               hot_key_rows: int = HOT_KEY_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Rows that start between ``low`` and ``high`` days after the previous row of the same key has ended.

    The previous row is the one before it by (start, end, tie), NULL starts first; overlaps do not count.
    """
    order = [F.col(c).asc_nulls_first() for c in (start, end, *tie)]
    seen = previous_values(df, key, order, {"previous_end": end}, hot_key_rows, counted)
    gap = F.date_diff(F.col(start), F.col("previous_end"))
    return seen.withColumn("gap_days", gap).filter(F.col("gap_days").between(low, high))


def period_change(df: DataFrame, period: str, value: str, out: str = "change") -> DataFrame:
    """Relative change against the previous period of a table with one row per period."""
    before = F.lag(value).over(W.orderBy(period))
    return df.withColumn(out, F.try_divide(F.col(value), before) - 1)
