"""Bootstrap intervals without resampling passes: Poisson(1) replicate weights keyed by row hash.

Each row draws its weight in every replicate from an md5 of its id, so replicates are repeatable and independent of partitioning.
The draws of all replicates are one binary value a row, made where it is needed and never shuffled; tasks add up arrays with one
entry a replicate. For the AUC the scores are ordered once: a block of the order sends its first and its last score and the area
between, and neighbouring blocks are joined by those, so that ties may lie across blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS_PER_HASH = 4  # 32-bit draws in one md5
LEVELS = 9
# smallest draw that reaches weight k + 1
POISSON_CUTS = tuple(
    math.ceil(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(LEVELS))
REGRESSION = ("predictive_ratio", "r2", "cpm", "r2_norm", "cpm_norm")


def draws(key: str, n: int, seed: int) -> Column:
    """The 32-bit draws of ``n`` replicates, four from each md5 of (key, seed, number)."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))
    return F.concat(*[F.unhex(F.md5(F.concat(text, F.lit(f"|{h}")))) for h in range(math.ceil(n / DRAWS_PER_HASH))])


def weights(column: pa.Array, n: int) -> np.ndarray:
    """(rows, n) weights."""
    drawn = np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), -1)[:, :n]
    return sum((drawn >= cut).astype(np.float64) for cut in POISSON_CUTS)


def _sums(rows: DataFrame, n: int, terms) -> np.ndarray:
    """(terms, replicates): weighted sums over all rows of what ``terms`` makes of outcomes and predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                y, p = (batch.column(c).to_numpy() for c in ("_y", "_p"))
                part = np.stack(terms(y, p, weights(batch.column("_draws"), n)))
                found = part if found is None else found + part
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["body"])

    # one row a task; they are added up in tens before they reach the driver
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = [np.frombuffer(b) for batch in batches for b in batch.column("body").to_pylist()]
        if bodies:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(bodies, axis=0).tobytes()], pa.binary())], ["body"])

    parts = rows.mapInArrow(run, "body binary").repartition(8).mapInArrow(add, "body binary").toArrow().column("body").to_pylist()
    return np.sum([np.frombuffer(b) for b in parts], axis=0).reshape(-1, n) if parts else np.zeros((0, n))


def _replicates(df: DataFrame, columns: dict[str, np.ndarray]) -> DataFrame:
    """One row a replicate; not a number becomes null."""
    frame = pd.DataFrame({"replicate": np.arange(len(next(iter(columns.values())))), **columns})
    table = pa.table({c: pa.array(frame[c], from_pandas=True) for c in frame})
    return df.sparkSession.createDataFrame(table)


def bootstrap_regression(df: DataFrame, y: str, p: str, key: str, n: int = 200, seed: int = 2024) -> DataFrame:
    """Per replicate: R2, Cumming's measure and predictive ratio, raw and normalised within the replicate.

    Rows without outcome or prediction are left out; without rows there are no replicates.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"), draws(key, n, seed).alias("_draws"))
    first = _sums(rows, n, lambda y, p, w: [w.sum(axis=0), y @ w, p @ w])
    if not len(first):
        return _replicates(df, dict.fromkeys(REGRESSION, np.zeros(0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        size, actual, predicted = np.where(first == 0, np.nan, first)
        mean, factor = actual / size, actual / predicted

        def terms(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
            raw, norm, dev = (y - p)[:, None], y[:, None] - p[:, None] * factor, y[:, None] - mean
            return [(w * f(e)).sum(axis=0) for e in (raw, norm, dev) for f in (np.square, np.abs)]

        raw2, raw1, norm2, norm1, dev2, dev1 = _sums(rows, n, terms)
        dev2, dev1 = (np.where(x == 0, np.nan, x) for x in (dev2, dev1))
        return _replicates(df, dict(zip(REGRESSION, (first[2] / actual, 1 - raw2 / dev2, 1 - raw1 / dev1, 1 - norm2 / dev2, 1 - norm1 / dev1))))


# --- area under the curve: a stretch of ordered scores as [first score, what lies between, last score] ---

#: score (None: several), then per replicate: weight of the positive and of the negative rows, area among them
Piece = tuple[float | None, np.ndarray, np.ndarray, np.ndarray]


def _between(pieces: list[Piece]) -> Piece:
    pos = neg = area = np.zeros_like(pieces[0][1])
    for _, p, q, a in pieces:
        area = area + a + p * neg  # pairs of a positive row and a negative one with a lower score
        pos, neg = pos + p, neg + q
    return None, pos, neg, area


def _joined(left: list[Piece], right: list[Piece]) -> list[Piece]:
    """Two neighbouring stretches as one; a score at the seam that both have becomes one score."""
    if left and right and left[-1][0] == right[0][0]:
        (score, p, q, _), (_, p2, q2, _) = left[-1], right[0]
        left, right = [*left[:-1], (score, p + p2, q + q2, (p + p2) * (q + q2) / 2)], right[1:]
    pieces = [*left, *right]
    return pieces if len(pieces) < 3 else [pieces[0], _between(pieces[1:-1]), pieces[-1]]


def _stretches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, block = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("_block")[0].as_py()
            score, y, w = batch.column("_p").to_numpy(), batch.column("_y").to_numpy(), weights(batch.column("_draws"), n)
            first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
            pos = np.add.reduceat(w * (y == 1)[:, None], first)
            neg = np.add.reduceat(w * (y != 1)[:, None], first)
            groups = [(float(score[i]), a, b, a * b / 2) for i, a, b in ((first[k], pos[k], neg[k]) for k in (0, len(first) - 1))]
            if len(first) > 2:
                before = np.cumsum(neg[1:-1], axis=0) - neg[1:-1]
                area = (pos[1:-1] * (before + neg[1:-1] / 2)).sum(axis=0)
                groups.insert(1, (None, pos[1:-1].sum(axis=0), neg[1:-1].sum(axis=0), area))
            found = _joined(found, groups[:1] if len(first) == 1 else groups)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([np.concatenate(f[1:]).tobytes() for f in found], pa.binary())], ["block", "place", "score", "body"])

    return run


def bootstrap_auc(df: DataFrame, y: str, p: str, key: str, n: int = 200, seed: int = 2024,
                  out: str = "auc") -> DataFrame:
    """AUC of each replicate, ties counting half; replicates that drew one class only drop out.

    One range sort by score, whatever the number of replicates; three rows a block reach the driver. Rows without label or score
    are left out.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        F.col(y).cast("int").alias("_y"), (F.col(p).cast("double") + F.lit(0.0)).alias("_p"), F.col(key).alias("_id"))
    rows = rows.repartitionByRange("_p", "_id").sortWithinPartitions("_p", "_id").select(
        "_y", "_p", draws("_id", n, seed).alias("_draws"), F.spark_partition_id().alias("_block"))
    found = rows.mapInArrow(_stretches(n), "block int, place int, score double, body binary").toArrow().to_pylist()
    whole: list[Piece] = []
    for block in sorted({r["block"] for r in found}):
        mine = sorted((r for r in found if r["block"] == block), key=lambda r: r["place"])
        whole = _joined(whole, [(r["score"], *np.frombuffer(r["body"]).reshape(3, -1)) for r in mine])
    if not whole:
        return _replicates(df, {out: np.zeros(0)})
    _, pos, neg, area = _between(whole)
    with np.errstate(divide="ignore", invalid="ignore"):
        auc = np.where((pos > 0) & (neg > 0), area / (pos * neg), np.nan)
    return _replicates(df, {out: auc}).where(F.col(out).isNotNull())


def interval(replicates: DataFrame, metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval ``(metric, lower, upper)`` of each metric column (one value per replicate)."""
    tail = (1 - level) / 2
    wide = replicates.agg(*[F.percentile(F.col(m), F.lit([tail, 1 - tail])).alias(m) for m in metrics])
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("lower"), F.col(m)[1].alias("upper"))
                      for m in metrics])
    return wide.select(F.explode(items).alias("_x")).select("_x.*")
