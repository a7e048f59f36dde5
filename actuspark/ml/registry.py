"""The six models of a run, fitted together and scored side by side."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.ml.baselines import CredibilityRate, NaivePersistence
from actuspark.ml.boosting import BoostedClassifier, BoostedCost, Boosting, fit_together
from actuspark.ml.linear import LogisticClassifier, TweedieGLM
from actuspark.session import concurrently


@dataclass(frozen=True)
class BoostingBudget:
    """How long the two boosted models may train; the defaults are those of a full run."""

    cost_rounds: int = 600
    class_rounds: int = 500
    cost_rate: float = 0.05
    class_rate: float = 0.05
    min_leaf_cost: int = 200
    min_leaf_class: int = 100


def cost_estimators(cfg: C.ClaimsConfig, budget: BoostingBudget = BoostingBudget()) -> dict:
    return {
        C.M0: NaivePersistence(), C.M1: CredibilityRate(), C.M2: TweedieGLM(cfg.features),
        C.M3: BoostedCost(cfg.features, max_iter=budget.cost_rounds, learning_rate=budget.cost_rate,
                          min_leaf=budget.min_leaf_cost, seed=cfg.seed),
    }


def class_estimators(cfg: C.ClaimsConfig, budget: BoostingBudget = BoostingBudget()) -> dict:
    return {
        C.C1: LogisticClassifier(cfg.features),
        C.C2: BoostedClassifier(cfg.features, max_iter=budget.class_rounds, learning_rate=budget.class_rate,
                                min_leaf=budget.min_leaf_class, seed=cfg.seed),
    }


def fit_all(train: DataFrame, estimators: Mapping[str, object], parallelism: int = 8) -> dict:
    """Fit every estimator on the same cached rows, several at a time; boosted models grow in common passes."""
    boosted = [n for n, e in estimators.items() if isinstance(e, Boosting)]
    alone = [n for n in estimators if n not in boosted]
    rows = train.persist()
    try:
        together, *single = concurrently(
            [lambda: fit_together(rows, [estimators[n] for n in boosted]), *[lambda n=n: estimators[n].fit(rows) for n in alone]], parallelism)
    finally:
        rows.unpersist()
    fitted = {**dict(zip(boosted, together)), **dict(zip(alone, single))}
    return {n: fitted[n] for n in estimators}


def score_all(df: DataFrame, models: Mapping[str, object], keep: list[str]) -> DataFrame:
    """Long predictions ``(keep..., model, prediction)``: each row is read once and scored by every model."""
    wide = df
    names = list(models)
    for i, name in enumerate(names):
        wide = models[name].transform(wide, f"_p{i}")
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").cast("double").alias("prediction"))
                                for i, name in enumerate(names)]))
    return wide.select(*keep, pairs.alias("_x")).select(*keep, "_x.model", "_x.prediction")
