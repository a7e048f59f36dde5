"""Generalised linear cost model and logistic classifier on log amounts and standardised features, fitted by Newton's method.

The standardised rows are stored once in blocks. A step reads them once: every block adds its part of the loss, the gradient and
the matrix of second derivatives (features squared, whatever the number of rows), which are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.ml.baselines import PREDICTION
from actuspark.ml.blocks import numbers, packed, total
from actuspark.session import materialize, release

#: Loss, first and second derivative by the linear predictor.
Slopes = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def input_sql(feature: str) -> str:
    """A model input: log1p of an amount, another feature as it is."""
    return f"log1p(greatest(`{feature}`, 0.0D))" if feature in C.COST_FEATURES else f"CAST(`{feature}` AS double)"


@dataclass(frozen=True)
class LinearModel:
    """``gradient`` is the largest absolute derivative of the objective at the solution."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    is_classifier: bool
    unit: float = 1.0
    gradient: float = 0.0

    def transform(self, df: DataFrame, out: str = PREDICTION) -> DataFrame:
        """A null input counts as the mean of the training rows."""
        terms = [f"coalesce(({input_sql(f)} - {m!r}D) * {w / s!r}D, 0.0D)"
                 for f, m, s, w in zip(self.features, self.means, self.scales, self.weights)]
        score = F.expr(" + ".join([f"{self.intercept!r}D", *terms]))
        return df.withColumn(out, 1 / (1 + F.exp(-score)) if self.is_classifier else F.exp(score) * F.lit(self.unit))

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.weights)


def tweedie(power: float) -> Slopes:
    """Half the deviance under a log link, up to a constant; convex for powers between 1 and 2."""
    def slopes(y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = y * np.exp((1 - power) * score), np.exp((2 - power) * score)
        return a / (power - 1) + b / (2 - power), b - a, (power - 1) * a + (2 - power) * b

    return slopes


def logistic(y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-score))
    return np.logaddexp(0, score) - y * score, p - y, p * (1 - p)


def block_sums(slopes: Slopes, width: int, weights: np.ndarray):
    def sums(record: dict) -> Iterator[tuple[int, int, np.ndarray]]:
        x, y = np.frombuffer(record["x"]).reshape(width, record["n"]), np.frombuffer(record["y"])
        loss, first, second = slopes(y, weights @ x)
        yield 0, 0, np.concatenate([[loss.sum()], x @ first, ((x * second) @ x.T).reshape(-1)])

    return sums


def newton(blocks: DataFrame, slopes: Slopes, weights: np.ndarray, n: int, penalty: float, tolerance: float,
           max_iter: int) -> tuple[np.ndarray, float]:
    """Minimise mean loss + penalty / 2 * |w|^2 without the first weight; steps that do not lower it are halved."""
    width = len(weights)
    ridge = np.full(width, penalty)
    ridge[0] = 0.0

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        body = total(blocks, block_sums(slopes, width, w), n, width * (width + 1) + 1)[0, 0] / n
        return (float(body[0] + ridge @ (w * w) / 2), body[1:width + 1] + ridge * w,
                body[width + 1:].reshape(width, width) + np.diag(ridge))

    value, gradient, curvature = at(weights)
    for _ in range(max_iter):
        if np.abs(gradient).max() <= tolerance:
            break
        step, share = np.linalg.lstsq(curvature, gradient, rcond=1e-12)[0], 1.0
        while True:
            found = at(weights - share * step)
            if found[0] <= value or share < 1e-6:
                break
            share /= 2
        if not found[0] <= value:
            break  # nothing is left to gain at this precision
        weights, (value, gradient, curvature) = weights - share * step, found
    return weights, float(np.abs(gradient).max())


def fit_linear(df: DataFrame, features: Sequence[str], target: str, slopes: Slopes, penalty: Callable[[int, float], float],
               start: Callable[[float], float], relative: bool, tolerance: float, max_iter: int) -> LinearModel:
    """Rows without a target take no part; a constant feature has weight 0; without rows the model predicts a constant."""
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.where(F.col(target).isNotNull()).select(*[F.expr(input_sql(f)).alias(x) for f, x in zip(features, names)],
                                                      F.col(target).cast("double").alias("_y"))
    rows = materialize(rows, "linear")
    row = rows.agg(F.count("*"), F.avg("_y"), *[a(x) for a in (F.avg, F.stddev_pop) for x in names]).first()
    n, mean = row[0], row[1] or 0.0
    means = np.array([m or 0.0 for m in row[2:2 + len(names)]])
    scales = np.array([s or 1.0 for s in row[2 + len(names):]])
    unit = mean if relative and mean > 0 else 1.0
    if not n:
        release(rows)
        return LinearModel(tuple(features), tuple(means.tolist()), tuple(scales.tolist()), (0.0,) * len(names), 0.0, not relative)

    def pack(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = np.nan_to_num((numbers(part, names) - means[:, None]) / scales[:, None])
        return {"x": np.vstack([np.ones((1, part.num_rows)), x]), "y": numbers(part, ["_y"])[0] / unit}

    blocks = packed(rows, pack, ["x", "y"], "linear", n)
    release(rows)
    first = np.zeros(len(names) + 1)
    first[0] = start(mean / unit)
    weights, gradient = newton(blocks, slopes, first, n, penalty(n, unit), tolerance, max_iter)
    release(blocks)
    return LinearModel(tuple(features), tuple(means.tolist()), tuple(scales.tolist()), tuple(weights[1:].tolist()), float(weights[0]),
                       not relative, unit, gradient)


@dataclass(frozen=True)
class TweedieGLM:
    """Tweedie regression with a log link, ridge penalty ``alpha`` / 2 on half the mean deviance.

    Fitted on outcomes relative to their mean, so that the solver starts near its solution; the penalty is converted exactly.
    """

    features: tuple[str, ...] = C.FEATURES
    target: str = C.TARGET
    power: float = 1.5
    alpha: float = 0.01
    tolerance: float = 1e-9
    max_iter: int = 100

    def fit(self, df: DataFrame) -> LinearModel:
        if not 1 < self.power < 2:
            raise ValueError("the power lies between 1 and 2")
        return fit_linear(df, self.features, self.target, tweedie(self.power), lambda _, unit: self.alpha / unit ** (2 - self.power),
                          lambda mean: 0.0, True, self.tolerance, self.max_iter)


@dataclass(frozen=True)
class LogisticClassifier:
    """Ridge logistic regression with inverse penalty ``c`` on the summed loss."""

    features: tuple[str, ...] = C.FEATURES
    target: str = C.LABEL
    c: float = 0.5
    tolerance: float = 1e-9
    max_iter: int = 100

    def fit(self, df: DataFrame) -> LinearModel:
        odds = lambda mean: float(np.log(max(mean, 1e-12) / max(1 - mean, 1e-12)))
        return fit_linear(df, self.features, self.target, logistic, lambda n, _: 1 / (self.c * n), odds, False, self.tolerance, self.max_iter)
