"""Discrimination and calibration metrics of probability predictions.

AUC, KS and ROC come from one table with a row per distinct score and running counts over it. Rows are combined
per score before they are ordered, so ties cost nothing, and groups share one global ordering.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.functions.columns import divide
from actuspark.operators.ranking import attach, equal_frequency_bins, exact_quantiles, join_groups, running_totals
from actuspark.session import concurrently


def score_table(df: DataFrame, y: str, p: str, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per distinct score, from the highest down: positives, negatives and their running totals (tp, fp)."""
    w = F.col(weight) if weight else F.lit(1)
    label = F.col(y).cast("int")
    counted = df.groupBy(*group, F.col(p).alias("score")).agg(
        F.sum(w * label).cast("bigint").alias("pos"), F.sum(w * (1 - label)).cast("bigint").alias("neg"))
    counted = counted.withColumn("_one", F.lit(1))
    return running_totals(
        counted, [F.col("score").desc()], {"tp": "pos", "fp": "neg", "position": "_one"}, group).drop("_one")


def _areas(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    above = F.col("tp") - F.col("pos")
    won = F.col("neg").cast("double") * (above + F.col("pos") / 2)
    sums = scores.groupBy(*group).agg(
        F.sum(won).alias("_won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.withColumn("auc", divide("_won", F.col("n_pos").cast("double") * F.col("n_neg"))).drop("_won")


def auc(df: DataFrame, y: str, p: str, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with half credit for ties; NULL when a group has one class only."""
    return _areas(score_table(df, y, p, group, weight), group)


def auc_and_ks(df: DataFrame, y: str, p: str, group: Sequence[str] = ()) -> DataFrame:
    """AUC, 2 AUC - 1 and the Kolmogorov-Smirnov distance."""
    scores = score_table(df, y, p, group)
    areas = _areas(scores, group)
    rows = attach(scores, areas, group)
    gap = divide(F.col("tp").cast("double"), F.col("n_pos")) - divide(F.col("fp").cast("double"), F.col("n_neg"))
    ks = rows.groupBy(*group).agg(F.greatest(F.max(gap), F.lit(0.0)).alias("ks"))
    joined = join_groups(areas, ks, group)
    return joined.select(*group, "auc", (2 * F.col("auc") - 1).alias("gini"), "ks", "n_pos", "n_neg")


def roc_curve(df: DataFrame, y: str, p: str, points: int = 200) -> DataFrame:
    """ROC points ``(position, fpr, tpr)``, thinned evenly to at most ``points`` with both ends kept."""
    scores = score_table(df, y, p)
    totals = scores.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.count(F.lit(1)).alias("_d"))
    rows = attach(scores, totals, ())
    steps = points - 1
    near = F.expr(f"(position * {steps} + _d - 1) div _d")
    kept = rows.withColumn("_i", near).filter(F.expr(f"(_i * _d) div {steps} = position OR _d <= {steps}"))
    curve = kept.select(
        "position", divide(F.col("fp").cast("double"), F.col("_n")).alias("fpr"),
        divide(F.col("tp").cast("double"), F.col("_p")).alias("tpr"))
    start = totals.select(F.lit(0).cast(curve.schema["position"].dataType).alias("position"),
                          F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(start)


def calibration_table(df: DataFrame, y: str, p: str, key: str, bins: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Mean probability, observed rate and size by equal-frequency bin of the probability."""
    return _binned(df, y, p, key, bins, group).select(
        *group, "bin", (F.col("_e") / F.col("n")).alias("mean_pred"), (F.col("_o") / F.col("n")).alias("obs_rate"),
        "n")


def _binned(df: DataFrame, y: str, p: str, key: str, bins: int, group: Sequence[str]) -> DataFrame:
    slim = df.select(*group, F.col(y).cast("int").alias("_y"), F.col(p).alias("_p"), F.col(key).alias("_id"))
    binned = equal_frequency_bins(slim, [F.col("_p"), F.col("_id")], bins, "bin", group)
    return binned.groupBy(*group, "bin").agg(
        F.sum("_y").alias("_o"), F.sum("_p").alias("_e"), F.count(F.lit(1)).alias("n"))


def hosmer_lemeshow(df: DataFrame, y: str, p: str, key: str, bins: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Hosmer-Lemeshow statistic and chi-square p-value (closed form, so ``bins`` must be even)."""
    if bins % 2:
        raise ValueError("bins must be even")
    o, e, n = F.col("_o"), F.col("_e"), F.col("n")
    table = _binned(df, y, p, key, bins, group)
    stat = table.groupBy(*group).agg(F.sum(divide((o - e) * (o - e), e * (1 - e / n))).alias("hl_stat"))
    half = F.col("hl_stat") / 2
    series = sum((F.pow(half, F.lit(i)) / math.factorial(i) for i in range((bins - 2) // 2)), F.lit(0.0))
    return stat.withColumn("hl_pvalue", F.exp(-half) * series)


def classification_metrics(df: DataFrame, y: str, p: str, key: str, group: Sequence[str] = (),
                           top_share: float = 0.1) -> DataFrame:
    """AUC, Gini, KS, Brier, precision / recall / lift in the top share, Hosmer-Lemeshow and rates."""
    slim = df.select(*group, F.col(y).cast("int").alias("_y"), F.col(p).cast("double").alias("_p"),
                     F.col(key).alias("_id"))
    cut, areas, hl = concurrently([
        lambda: exact_quantiles(slim, "_p", [1 - top_share], group, "_cut").drop("prob"),
        lambda: auc_and_ks(slim, "_y", "_p", group).drop("n_pos", "n_neg"),
        lambda: hosmer_lemeshow(slim, "_y", "_p", "_id", 10, group)])
    top = F.col("_p") >= F.col("_cut")
    sums = attach(slim, cut, group).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_pos"), F.sum("_p").alias("_sp"),
        F.sum((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("_sq"),
        F.sum(top.cast("int")).alias("_nt"), F.sum(F.when(top, F.col("_y")).otherwise(0)).alias("_pt"))
    rate, precision = F.col("_pos") / F.col("n"), divide(F.col("_pt").cast("double"), F.col("_nt"))
    metrics = sums.select(
        *group, "n", (F.col("_sq") / F.col("n")).alias("brier"), precision.alias("precision_top"),
        divide(F.col("_pt").cast("double"), F.col("_pos")).alias("recall_top"),
        divide(precision, rate).alias("lift_top"), rate.alias("event_rate"),
        (F.col("_sp") / F.col("n")).alias("mean_probability"))
    return join_groups(join_groups(metrics, areas, group), hl, group)
