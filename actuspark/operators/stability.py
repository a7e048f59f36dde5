"""Distribution shift: population and characteristic stability indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark.functions.columns import divide
from actuspark.operators.ranking import attach, exact_quantiles, join_groups
from actuspark.session import small_table

SHARE_FLOOR = 1e-6
EDGE_DIGITS = 6


def quantile_edges(expected: DataFrame, value: str, bins: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Inner bin edges ``_edges`` and bin count ``n_bins`` per group: distinct quantiles, the outer two open."""
    cuts = exact_quantiles(expected, value, [i / bins for i in range(bins + 1)], group, "_cut")
    lists = cuts.groupBy(*group).agg(
        F.array_sort(F.collect_set(F.round("_cut", EDGE_DIGITS))).alias("_all"))
    inner = F.when(F.size("_all") > 2, F.slice("_all", F.lit(2), F.size("_all") - 2)).otherwise(
        F.array().cast("array<double>"))
    return lists.select(*group, inner.alias("_edges"), (F.size("_all") - 1).alias("n_bins"))


def bin_number(v: Column, edges: str, most: int) -> Column:
    """1 + number of inner edges at or below the value (bins are closed on the left)."""
    total = F.lit(1)
    for i in range(most):
        total = total + F.coalesce((v >= F.get(F.col(edges), F.lit(i))).cast("int"), F.lit(0))
    return total


def psi_table(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10,
              group: Sequence[str] = ()) -> DataFrame:
    """Bin table of a PSI: bounds, shares of both samples and the contribution of each bin."""
    edges = small_table(quantile_edges(expected, value, bins, group))
    sides = expected.select(*group, value, F.lit(1).alias("_e")).unionByName(
        actual.select(*group, value, F.lit(0).alias("_e")))
    rows = attach(sides.filter(F.col(value).isNotNull()), edges, group)
    counts = rows.groupBy(*group, bin_number(F.col(value), "_edges", bins - 1).alias("bin")).agg(
        F.sum("_e").alias("_ne"), F.sum(1 - F.col("_e")).alias("_na"))
    whole = counts.groupBy(*group).agg(F.sum("_ne").alias("_te"), F.sum("_na").alias("_ta"))
    grid = edges.filter("n_bins > 0").select(
        *group, "_edges", "n_bins", F.explode(F.sequence(F.lit(1), F.col("n_bins"))).alias("bin"))
    full = join_groups(join_groups(grid, counts, [*group, "bin"]), whole, group)
    share = lambda n, t: F.greatest(divide(F.coalesce(n, F.lit(0)).cast("double"), t), F.lit(SHARE_FLOOR))
    full = full.select(
        *group, "bin",
        F.when(F.col("bin") == 1, F.lit(float("-inf"))).otherwise(F.get("_edges", F.col("bin") - 2)).alias("lower"),
        F.when(F.col("bin") == F.col("n_bins"), F.lit(float("inf"))).otherwise(
            F.get("_edges", F.col("bin") - 1)).alias("upper"),
        share(F.col("_ne"), F.col("_te")).alias("expected_pct"),
        share(F.col("_na"), F.col("_ta")).alias("actual_pct"))
    return full.withColumn("psi_contrib", (F.col("actual_pct") - F.col("expected_pct"))
                           * F.log(F.col("actual_pct") / F.col("expected_pct")))


def psi(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10, group: Sequence[str] = (),
        out: str = "psi") -> DataFrame:
    table = psi_table(expected, actual, value, bins, group)
    return table.groupBy(*group).agg(F.coalesce(F.sum("psi_contrib"), F.lit(0.0)).alias(out),
                                     F.count(F.lit(1)).alias("n_bins"))


def psi_over_periods(df: DataFrame, period: str, value: str, reference: str, bins: int = 10) -> DataFrame:
    """PSI of every period against a reference period: one pass, bins cut on the reference."""
    known = df.filter(F.col(value).isNotNull())
    edges = small_table(quantile_edges(known.filter(F.col(period) == reference), value, bins))
    rows = attach(known, edges, ())
    counts = rows.groupBy(period, bin_number(F.col(value), "_edges", bins - 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("_c"))
    # from here on: periods x bins rows
    totals = counts.groupBy(period).agg(F.sum("_c").alias("n"))
    n_bins = edges.select("n_bins").first()[0]
    grid = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(max(n_bins, 1)))).alias("bin"))
    base = counts.filter(F.col(period) == reference).select("bin", F.col("_c").alias("_b"))
    base_total = totals.filter(F.col(period) == reference).select(F.col("n").alias("_bn"))
    full = attach(join_groups(join_groups(grid, counts, [period, "bin"]), base, ["bin"]), base_total, ())
    share = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(n), F.lit(SHARE_FLOOR))
    e, a = share("_b", "_bn"), share("_c", "n")
    return full.groupBy(period, "n").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def psi_verdict(c: str) -> Column:
    return F.when(F.col(c) < 0.1, "Stable").when(F.col(c) < 0.25, "Monitor").otherwise("Significant shift")


def long_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, value)`` rows, all features from one scan."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("_x")).select("_x.feature", "_x.value")


def csi(train: DataFrame, expected: DataFrame, actual: DataFrame, features: Sequence[str],
        bins: int = 10) -> DataFrame:
    """Stability index of every feature that varies in ``train``: one grouped PSI, not one job per feature."""
    spread = train.agg(*[(F.min(f) < F.max(f)).alias(f) for f in features]).first()
    varying = [f for f in features if spread[f]]
    found = psi(long_features(expected, varying), long_features(actual, varying), "value", bins, ["feature"], "csi")
    # constant in the expected sample: no bins, index 0
    names = expected.sparkSession.createDataFrame([(f,) for f in varying], "feature string")
    return names.join(found, "feature", "left").select(
        "feature", F.coalesce("csi", F.lit(0.0)).alias("csi"), F.coalesce("n_bins", F.lit(0)).alias("n_bins"))
