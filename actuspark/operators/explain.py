"""Importance, dependence and input shocks for any fitted model with ``transform(df, out)``.

Every question becomes extra rows of one frame, so the model is called once instead of once per feature. Boosted models need no
extra rows: each row is scored once per tree, and where one feature changes only the trees that split on it are walked again;
sums leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.functions.columns import hash_number
from actuspark.ml.blocks import numbers, packed, total
from actuspark.ml.boosting import BoostedModel
from actuspark.operators.ranking import exact_quantiles, global_rank
from actuspark.operators.shaping import hash_sample
from actuspark.session import materialize, release


def explain_sample(df: DataFrame, key: str, seed: int = 2024, size: int | None = None) -> DataFrame:
    """The rows that importance and dependence work on: all of them, or a keyed-hash sample of ``size`` rows."""
    return materialize(df if size is None else hash_sample(df, [key], seed, size), "sample")


def permutation_importance(model, sample: DataFrame, features: Sequence[str], y: str, key: str, repeats: int = 3,
                           seed: int = 2024) -> DataFrame:
    """Rise of the mean absolute error when one feature is shuffled: mean and deviation over the repeats.

    Row i borrows the feature from the row at position i of a keyed-hash order; both orders are distributed ranks.
    """
    base = sample.select(F.col(key).alias("_id"), F.col(y).cast("double").alias("_y"), *features)
    base = global_rank(base, [F.col("_id")], "_i")
    donors = None
    for r in range(repeats):
        mine = base.drop("_i", "_y").withColumn("_order", hash_number("_id", f"{seed}|{r}"))
        ranked = global_rank(mine, [F.col("_order"), F.col("_id")], "_i")
        one = ranked.select(F.lit(r).alias("_r"), "_i", *[F.col(f).alias(f"_d_{f}") for f in features])
        donors = one if donors is None else donors.unionByName(one)
    if isinstance(model, BoostedModel):
        return _importance_of_trees(model, base.join(donors, "_i"), features, repeats)
    which = F.explode(F.array(*[F.lit(f) for f in features]))
    rows = base.join(donors, "_i").select("*", which.alias("_f"))
    rows = rows.select("_y", "_r", "_f", *[
        F.when(F.col("_f") == f, F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    shuffled = model.transform(rows, "_p").groupBy("_f", "_r").agg(F.avg(F.abs(F.col("_y") - F.col("_p"))).alias("_mae"))
    plain = model.transform(base, "_p").agg(F.avg(F.abs(F.col("_y") - F.col("_p")))).first()[0]
    return shuffled.groupBy(F.col("_f").alias("feature")).agg(
        (F.avg("_mae") - F.lit(plain)).alias("importance"), F.stddev_pop("_mae").alias("std"))


def _inputs(record: dict, name: str, width: int) -> np.ndarray:
    return np.nan_to_num(np.frombuffer(record[name]).reshape(width, record["n"]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _importance_of_trees(model: BoostedModel, rows: DataFrame, features: Sequence[str], repeats: int) -> DataFrame:
    """Rows hold the features, those of the donor (``_d_*``), the outcome and the repeat ``_r``."""
    spark, inputs, index = rows.sparkSession, list(model.features), model.trees_by_feature()
    borrowed = [f"_d_{f}" if f in features else f for f in inputs]

    def pack(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"x": numbers(part, inputs), "given": numbers(part, borrowed), "y": numbers(part, ["_y", "_r"])}

    doubles = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*inputs, *borrowed, "_y", "_r"])]
    held = materialize(rows.select(*doubles), "borrowed")
    n = held.count()
    blocks = packed(held, pack, ["x", "given", "y"], "borrowed", n)
    release(held)

    def sums(record: dict) -> Iterator[tuple[int, int, np.ndarray]]:
        x, given = (_inputs(record, c, len(inputs)) for c in ("x", "given"))
        y, repeat = np.frombuffer(record["y"]).reshape(2, -1)
        score = model.start + model.steps(x, range(len(model.trees)))

        def error(moved: np.ndarray) -> np.ndarray:
            return np.bincount(repeat.astype(np.int64), np.abs(y - model.mean(moved)), repeats)

        yield 0, -1, np.concatenate([error(score), [len(y)]])
        for f, trees in index.items():
            changed = x.copy()
            changed[f] = given[f]
            yield 0, f, error(score + model.steps(changed, trees) - model.steps(x, trees))

    found = total(blocks, sums, n, (len(index) + 1) * (repeats + 1))
    release(blocks)
    out = []
    if (0, -1) in found:
        size = found[0, -1][-1] / repeats  # rows of the sample: each occurs once a repeat
        plain = found[0, -1][:-1] / size
        for f in features:  # one that no tree splits on changes nothing
            mae = found.get((0, inputs.index(f) if f in inputs else len(inputs)), found[0, -1][:-1]) / size
            out.append((f, float(mae.mean() - plain.mean()), float(mae.std())))
    return spark.createDataFrame(out, "feature string, importance double, std double")


def top_features(importance: DataFrame, n: int = 4) -> list[str]:
    return [r["feature"] for r in importance.orderBy(F.desc("importance"), "feature").limit(n).collect()]


def partial_dependence(model, sample: DataFrame, features: Sequence[str], inputs: Sequence[str],
                       points: int = 20) -> DataFrame:
    """Mean prediction as one feature runs over an even grid of its 5-95 % range (or its few distinct values)."""
    grid = []
    for f in features:
        known = sample.select(F.col(f).alias("v")).filter(F.col("v").isNotNull())
        values = sorted(r.v for r in known.distinct().limit(points).collect())
        if len(values) >= points:
            low, high = (r["quantile"] for r in exact_quantiles(known, "v", [0.05, 0.95]).orderBy("prob").collect())
            values = [low + (high - low) * i / (points - 1) for i in range(points)]
        grid += [(f, float(v)) for v in values]
    if isinstance(model, BoostedModel):
        return _dependence_of_trees(model, sample, grid)
    at = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("value")) for f, v in grid]))
    rows = sample.select(*inputs, at.alias("_g")).select("_g.feature", "_g.value", *inputs)
    rows = rows.select("feature", "value", *[
        F.when(F.col("feature") == f, F.col("value")).otherwise(F.col(f)).alias(f) if f in features else F.col(f)
        for f in inputs])
    return model.transform(rows, "_p").groupBy("feature", "value").agg(F.avg("_p").alias("avg_pred"))


def _dependence_of_trees(model: BoostedModel, sample: DataFrame, grid: list[tuple[str, float]]) -> DataFrame:
    spark, inputs, index = sample.sparkSession, list(model.features), model.trees_by_feature()
    n = sample.count()
    blocks = packed(sample.select(*[F.col(f).cast("double").alias(f) for f in inputs]),
                    lambda part: {"x": numbers(part, inputs)}, ["x"], "sample", n)

    def sums(record: dict) -> Iterator[tuple[int, int, np.ndarray]]:
        x = _inputs(record, "x", len(inputs))
        score, out = model.start + model.steps(x, range(len(model.trees))), np.zeros(len(grid))
        for f in dict.fromkeys(f for f, _ in grid):
            at = inputs.index(f)
            trees = index.get(at, [])
            rest, changed = score - model.steps(x, trees), x.copy()
            for k, (g, value) in enumerate(grid):
                if g == f:
                    changed[at] = value
                    out[k] = model.mean(rest + model.steps(changed, trees)).sum()
        yield 0, 0, out

    found = total(blocks, sums, n, len(grid)) if grid else {}
    release(blocks)
    means = found[0, 0] / n if found else []
    return spark.createDataFrame([(f, v, float(m)) for (f, v), m in zip(grid, means)], "feature string, value double, avg_pred double")


def cost_shock(shock: float) -> dict[str, Column]:
    """All prior amounts scaled by 1 + shock, with the log total recomputed."""
    scaled = {c: F.col(c) * (1 + shock) for c in C.COST_FEATURES}
    return {**scaled, "log_paid_total": F.log1p(F.col("paid_total") * (1 + shock))}


def plus_one(feature: str) -> dict[str, Column]:
    return {feature: F.col(feature) + 1}


def standard_shocks() -> dict[str, dict[str, Column]]:
    """The five standard shocks. Names and sizes."""
    return {
        "Prior-year costs -10%": cost_shock(-0.10), "Prior-year costs +10%": cost_shock(0.10),
        "Prior-year costs +25%": cost_shock(0.25), "n_chronic +1 for all members": plus_one("n_chronic"),
        "ip_admits +1 for all members": plus_one("ip_admits"),
    }


def input_shocks(model, df: DataFrame, inputs: Sequence[str],
                 shocks: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """Relative change of the mean prediction under each shock; base and shocked rows share one scan."""
    shocks = standard_shocks() if shocks is None else shocks
    names = ["", *shocks]
    rows = df.select(*inputs, F.explode(F.array(*[F.lit(n) for n in names])).alias("_test"))
    changed = []
    for f in inputs:
        value = F.col(f)
        for name, change in shocks.items():
            if f in change:
                value = F.when(F.col("_test") == name, change[f]).otherwise(value)
        changed.append(value.alias(f))
    means = model.transform(rows.select("_test", *changed), "_p").groupBy("_test").agg(F.avg("_p").alias("_m"))
    # one row per shock
    base = F.max(F.when(F.col("_test") == "", F.col("_m"))).over(W.partitionBy(F.lit(1)))
    return means.select(F.col("_test").alias("test"), (F.col("_m") / base - 1).alias("mean_pred_change")).filter(
        "test <> ''")
