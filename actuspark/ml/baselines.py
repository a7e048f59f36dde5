"""Benchmark models whose state is a handful of numbers: trended persistence and credibility-weighted cell rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.functions.columns import band, hash_share, money_sum
from actuspark.session import small_table

PREDICTION = "prediction"


@dataclass(frozen=True)
class NaivePersistenceModel:
    prior: str
    trend: float
    floor: float

    def expression(self) -> Column:
        return F.greatest(F.col(self.prior) * F.lit(self.trend), F.lit(self.floor))

    def transform(self, df: DataFrame, out: str = PREDICTION) -> DataFrame:
        return df.withColumn(out, self.expression())


@dataclass(frozen=True)
class NaivePersistence:
    """Prior amount times the overall trend, never below a quarter of the mean outcome."""

    prior: str = "paid_total"
    target: str = C.TARGET
    floor_share: float = 0.25

    def fit(self, df: DataFrame) -> NaivePersistenceModel:
        row = df.agg(money_sum(self.target).alias("y"), money_sum(self.prior).alias("x"),
                     F.count(self.target).alias("n")).first()
        trend = row["y"] / max(row["x"], 1.0)
        return NaivePersistenceModel(self.prior, trend, row["y"] / row["n"] * self.floor_share)


@dataclass(frozen=True)
class CellRateModel:
    cells: Mapping[str, Column]
    mean: float
    rates: DataFrame

    def transform(self, df: DataFrame, out: str = PREDICTION) -> DataFrame:
        keyed = df.withColumns({f"_c_{name}": c for name, c in self.cells.items()})
        on = None
        for name in self.cells:
            test = F.col(f"_c_{name}").eqNullSafe(F.col(f"_r_{name}"))
            on = test if on is None else on & test
        rates = self.rates.select(*[F.col(n).alias(f"_r_{n}") for n in self.cells], F.col("rate").alias("_rate"))
        joined = keyed.join(rates, on, "left").withColumn(out, F.coalesce("_rate", F.lit(self.mean)))
        return joined.select(*[c for c in df.columns if c != out], out)


def age_sex_esrd() -> dict[str, Column]:
    return {"age_cell": band("age", *C.AGE_BANDS), "sex_cell": F.col("is_female"), "esrd_cell": F.col("esrd")}


@dataclass(frozen=True)
class CredibilityRate:
    """Mean outcome per rating cell, shrunk to the overall mean with weight n / (n + k)."""

    target: str = C.TARGET
    k: int = 200
    cells: Mapping[str, Column] | None = None

    def fit(self, df: DataFrame) -> CellRateModel:
        cells = dict(self.cells or age_sex_esrd())
        total = df.agg(money_sum(self.target).alias("y"), F.count(self.target).alias("n")).first()
        mean = total["y"] / total["n"]
        keyed = df.select(*[c.alias(name) for name, c in cells.items()], F.col(self.target).alias("_y"))
        stats = keyed.groupBy(*cells).agg(
            (money_sum("_y") / F.count("_y")).alias("cell_mean"), F.count("_y").alias("n"))
        z = F.col("n") / (F.col("n") + self.k)
        rates = stats.withColumn("rate", z * F.col("cell_mean") + (1 - z) * F.lit(mean))
        # bounded by the number of rating cells; joined by shuffle should somebody rate on very many
        return CellRateModel(cells, mean, small_table(rates))


@dataclass(frozen=True)
class Resampled:
    """An estimator fitted on a share of the rows, dealt by a hash of the key and the seed."""

    estimator: object
    seed: int
    share: float = 0.8
    key: str = "bene_id"

    def fit(self, df: DataFrame):
        return self.estimator.fit(df.filter(hash_share(self.key, f"refit|{self.seed}") < self.share))


def lookup_table(model: CellRateModel, names: Sequence[str] = ("cell_mean", "n", "rate")) -> DataFrame:
    return model.rates.select(*model.cells, *names)
