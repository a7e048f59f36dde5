"""Accuracy, ranking and calibration metrics of amount predictions, as grouped aggregations.

Every function takes optional ``group`` columns (for example model and sample) and returns one row per group.
``key`` is a unique row id: it breaks ties between equal predictions in a repeatable way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark.functions.columns import correlation, divide
from actuspark.operators.ranking import (
    attach, equal_frequency_bins, exact_quantiles, global_rank, join_groups, running_totals,
)
from actuspark.session import concurrently


def _lift_area(n: Column, total: Column, weighted: Column) -> Column:
    """Area under the cumulative share curve minus that of the diagonal, from sum(a) and sum(a * rank)."""
    return divide((n + 1) * total - weighted, total) / n - (n + 1) / (2 * n)


def gini_norm(df: DataFrame, y: str, p: str, key: str, group: Sequence[str] = (), out: str = "gini") -> DataFrame:
    """Normalised Gini: ordering quality of ``p``, relative to the perfect ordering by ``y`` itself."""
    slim = df.select(*group, F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), F.col(key).alias("_id"))
    values = slim.groupBy(*group, "_y").agg(F.count(F.lit(1)).alias("_c"))
    ranked, upto = concurrently([
        lambda: global_rank(slim, [F.col("_p").desc(), F.col("_id")], "_rk", group),
        # the perfect ordering needs no tie-break: equal outcomes are one row with a count
        lambda: running_totals(values, [F.col("_y").desc()], {"_upto": "_c"}, group)])
    by_score = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_total"),
        F.sum(F.col("_y") * F.col("_rk")).alias("_weighted"))
    rank_sum = F.col("_c") * (2 * F.col("_upto") - F.col("_c") + 1) / 2
    perfect = upto.groupBy(*group).agg(F.sum(F.col("_y") * rank_sum).alias("_best"))
    both = join_groups(by_score, perfect, group)
    area = lambda w: _lift_area(F.col("_n"), F.col("_total"), F.col(w))
    return both.select(*group, divide(area("_weighted"), area("_best")).alias(out))


def regression_metrics(df: DataFrame, y: str, p: str, key: str, group: Sequence[str] = (),
                       top_share: float = 0.1) -> DataFrame:
    """R2, Cumming's measure, MAE, RMSE, predictive ratio, Gini, top-share capture and means."""
    slim = df.select(*group, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"),
                     F.col(key).alias("_id"))
    totals = slim.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_sy"), F.sum("_p").alias("_sp"))
    cut, gini = concurrently([
        lambda: exact_quantiles(slim, "_p", [1 - top_share], group, "_cut").drop("prob"),
        lambda: gini_norm(slim, "_y", "_p", "_id", group)])
    rows = attach(attach(slim, totals, group), cut, group)
    mean = F.col("_sy") / F.col("n")
    err, dev = F.col("_y") - F.col("_p"), F.col("_y") - mean
    sums = rows.groupBy(*group, "n", "_sy", "_sp").agg(
        F.sum(F.abs(err)).alias("_ae"), F.sum(F.abs(dev)).alias("_ad"),
        F.sum(err * err).alias("_se"), F.sum(dev * dev).alias("_sd"),
        F.sum(F.when(F.col("_p") >= F.col("_cut"), F.col("_y")).otherwise(0.0)).alias("_top"))
    metrics = sums.select(
        *group, "n",
        (1 - divide("_se", "_sd")).alias("r2"),
        (1 - divide("_ae", "_ad")).alias("cpm"),
        (F.col("_ae") / F.col("n")).alias("mae"),
        F.sqrt(F.col("_se") / F.col("n")).alias("rmse"),
        divide("_sp", "_sy").alias("predictive_ratio"),
        divide("_top", "_sy").alias("top_capture"),
        (F.col("_sy") / F.col("n")).alias("mean_actual"),
        (F.col("_sp") / F.col("n")).alias("mean_predicted"))
    return join_groups(metrics, gini, group)


def normalise(df: DataFrame, y: str, p: str, group: Sequence[str] = (), out: str | None = None,
              factor: str = "norm_factor") -> DataFrame:
    """Rescale predictions so that they add up to the actual total; the factor stays as a column."""
    totals = df.groupBy(*group).agg(divide(F.sum(F.col(y).cast("double")), F.sum(p)).alias(factor))
    return attach(df, totals, group).withColumn(out or p, F.col(p) * F.col(factor))


def decile_table(df: DataFrame, y: str, p: str, key: str, bins: int = 10, group: Sequence[str] = (),
                 out: str = "decile") -> DataFrame:
    """Predicted against actual by equal-frequency bin of the prediction."""
    slim = df.select(*group, F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"), F.col(key).alias("_id"))
    binned = equal_frequency_bins(slim, [F.col("_p"), F.col("_id")], bins, out, group)
    return summarise_bins(binned, "_y", "_p", [*group, out])


def summarise_bins(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Counts, sums, means and predictive ratio of rows that already carry their bin."""
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("pred_sum"), F.sum(F.col(y).cast("double")).alias("actual_sum"))
    return sums.select(
        "*", (F.col("pred_sum") / F.col("n")).alias("mean_pred"),
        (F.col("actual_sum") / F.col("n")).alias("mean_actual"),
        divide("pred_sum", "actual_sum").alias("predictive_ratio"))


def squared_correlation(df: DataFrame, y: str, p: str, out: str = "rsq") -> DataFrame:
    return df.agg(F.pow(correlation(y, p), 2).alias(out))


def feature_target_correlation(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Pearson correlation of every feature with the target, long form, from one scan. Constant features give NULL."""
    wide = df.agg(*[correlation(f, y).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr"))
                      for f in features])
    return wide.select(F.explode(pairs).alias("_x")).select("_x.feature", "_x.corr")
