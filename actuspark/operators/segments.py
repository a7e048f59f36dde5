"""Calibration and fairness by member segment, cross-tabs and monotonicity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actuspark.functions.columns import divide
from actuspark.operators.classification import auc
from actuspark.operators.ranking import join_groups, quantile_value
from actuspark.operators.shaping import grouped_sets


def segment_calibration(df: DataFrame, dimensions: Sequence[str], y: str, p: str) -> DataFrame:
    """Size, mean actual, mean predicted and predictive ratio (actual total at least 1) by each dimension."""
    actual, predicted = F.sum(F.col(y).cast("double")), F.sum(p)
    return grouped_sets(df.select(*dimensions, y, p), dimensions, [
        F.count(F.lit(1)).alias("n"), (actual / F.count(F.lit(1))).alias("actual_mean"),
        (predicted / F.count(F.lit(1))).alias("pred_mean"),
        (predicted / F.greatest(actual, F.lit(1.0))).alias("predictive_ratio")])


def segment_status(table: DataFrame, low: float = 0.85, high: float = 1.15, min_rows: int = 500) -> DataFrame:
    """BREACH for segments of at least ``min_rows`` whose ratio of means leaves the tolerance."""
    ratio = divide("pred_mean", "actual_mean")
    breach = (F.col("n") >= min_rows) & ((ratio < low) | (ratio > high))
    return table.withColumn("status", F.when(breach, "BREACH").otherwise("OK"))


def breaches(table: DataFrame, low: float = 0.85, high: float = 1.15, min_rows: int = 500) -> DataFrame:
    ratio = F.col("predictive_ratio")
    return table.filter((F.col("n") >= min_rows) & ((ratio < low) | (ratio > high)))


def fairness(df: DataFrame, dimensions: Sequence[str], y: str, p: str, top_share: float = 0.1) -> DataFrame:
    """Event rate, AUC, flag rate and true-positive rate at the overall top cut, by group. One-class groups drop out."""
    cut = quantile_value(df, p, 1 - top_share)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level"))
                                for d in dimensions]))
    rows = df.select(pairs.alias("_d"), F.col(y).cast("int").alias("_y"), F.col(p).alias("_p")).select(
        "_d.dimension", "_d.level", "_y", "_p").filter(F.col("level").isNotNull())
    by = ["dimension", "level"]
    flagged = F.col("_p") >= F.lit(cut)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("event_rate"),
        F.avg(flagged.cast("int")).alias("flag_rate_top"),
        (F.sum((flagged & (F.col("_y") == 1)).cast("int")) / F.greatest(F.sum("_y"), F.lit(1))).alias("tpr_top"))
    areas = auc(rows, "_y", "_p", by).filter("n_pos > 0 AND n_neg > 0").select(*by, "auc")
    return join_groups(sums, areas, by).filter(F.col("auc").isNotNull()).select(
        *by, "n", "event_rate", "auc", "flag_rate_top", "tpr_top")


def ratio_crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], y: str, p: str,
                   factor: float | Column = 1.0, where: Column | None = None,
                   names: Mapping[str, str] | None = None) -> DataFrame:
    """Predictive ratio of every row level by column value and overall, with size and mean actual."""
    src = df if where is None else df.filter(where)
    scale = factor if isinstance(factor, Column) else F.lit(float(factor))
    aggs = []
    for v in values:
        inside = F.col(column) == v
        aggs.append((divide(F.sum(F.when(inside, F.col(p))), F.sum(F.when(inside, F.col(y).cast("double")))) * scale)
                    .alias((names or {}).get(v, f"{v.lower()}_ratio")))
    actual = F.sum(F.col(y).cast("double"))
    return src.groupBy(row).agg(
        *aggs, (divide(F.sum(p), actual) * scale).alias("all_ratio"), F.count(F.lit(1)).alias("n"),
        (actual / F.count(F.lit(1))).alias("actual_mean"))


def monotonicity(df: DataFrame, ordinal: str, p: str, cap: int = 8, out: str = "level") -> DataFrame:
    """Mean prediction by capped ordinal with the step from the previous level."""
    means = df.groupBy(F.least(F.col(ordinal), F.lit(cap)).alias(out)).agg(F.avg(p).alias("mean_pred"))
    return means.withColumn("step", F.col("mean_pred") - F.lag("mean_pred").over(W.orderBy(out)))


def is_monotonic(table: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row: whether no step falls by more than ``tolerance`` of the mean level."""
    return table.agg(F.coalesce(F.min("step") > -tolerance * F.avg("mean_pred"), F.lit(True)).alias("monotonic"))
