"""Gradient boosting on histograms: one learner for the Poisson or squared-error cost model and the classifier.

Features are binned once to bytes and stored in blocks. A round grows one tree, always at the leaf of greatest gain: a pass over
the blocks adds gradients, hessians and counts per (node, feature, bin) for the children of all leaves that may still be split.
The tasks that hold the whole sums of a node find its best split, and only that reaches the driver. Any number of models (losses,
targets, seeds, settings, feature sets) grow in the same passes over the same blocks, each with its own rows and features.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actuspark import config as C
from actuspark.functions.columns import hash_share
from actuspark.ml.baselines import PREDICTION
from actuspark.ml.blocks import kept, numbers, packed, records, total
from actuspark.session import materialize, release

#: A leaf whose hessians add up to less is not split off.
LEAST_HESSIAN = 1e-3
TRAIN, VALID = 1, 2
#: Rows times models of a pass's task: below that one task is quicker than a shuffle.
PASS_ROWS = 1 << 17
#: Gains that differ by less than this share are equal.
SAME_GAIN = 1e-9
#: Cells of a bundle of features, which one byte numbers.
BUNDLE = 256


@dataclass(frozen=True)
class FlatTree:
    """One tree as parallel node arrays; a leaf has feature -1 and holds its step. Rows up to the threshold go left."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    step: tuple[float, ...]

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


def landed(tree: FlatTree, x: np.ndarray) -> np.ndarray:
    """The node at which each column of ``x`` (features, rows) ends. Children stand behind their parents.

    Who is at a node is one byte a row, and leaves add up to the numbers of the ends: whole bytes are quicker than rows picked.
    """
    kind = np.uint8 if len(tree.feature) <= 256 else np.int32
    node = np.zeros(x.shape[1], kind)
    here = {0: np.ones(x.shape[1], bool)}
    for at, f in enumerate(tree.feature):
        mine = here.pop(at, None)
        if mine is None:
            continue  # no longer part of the tree
        if f >= 0:
            low = x[f] <= tree.threshold[at]
            here[tree.left[at]], here[tree.right[at]] = mine & low, mine > low
        elif at:
            node += mine.view(np.uint8) * kind(at)
    return node


def ensemble_score(trees: list[FlatTree], start: float):
    """Arrow-batched sum of tree steps. One call replaces hundreds of chained tree transforms in the plan."""

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([np.nan_to_num(c.to_numpy(dtype=float), nan=-np.inf, posinf=np.inf, neginf=-np.inf) for c in columns])
        out = np.full(x.shape[1], start)
        for tree in trees:
            out += np.array(tree.step)[landed(tree, x)]
        return pd.Series(out)

    return score


@dataclass(frozen=True)
class BoostedModel:
    """``validation_losses`` begins with the loss of the constant model."""

    features: tuple[str, ...]
    start: float
    trees: list[FlatTree]
    loss: str
    validation_losses: list[float] = field(default_factory=list)

    def mean(self, score: np.ndarray) -> np.ndarray:
        return {"poisson": np.exp, "logistic": lambda s: 1 / (1 + np.exp(-s)), "squared_error": lambda s: s}[self.loss](score)

    def steps(self, x: np.ndarray, trees: Sequence[int]) -> np.ndarray:
        """The sum of the steps of some trees for each column of ``x`` (features, rows)."""
        return moved(np.zeros(x.shape[1]), x, [self.trees[t] for t in trees])

    def trees_by_feature(self) -> dict[int, list[int]]:
        """The trees that split on a feature: only these see it change."""
        index: dict[int, list[int]] = {}
        for t, tree in enumerate(self.trees):
            for f in sorted(set(tree.feature) - {-1}):
                index.setdefault(f, []).append(t)
        return index

    def transform(self, df: DataFrame, out: str = PREDICTION) -> DataFrame:
        score = ensemble_score(self.trees, self.start)(*[F.col(f).cast("double") for f in self.features])
        if self.loss == "logistic":
            return df.withColumn(out, 1 / (1 + F.exp(-score)))
        return df.withColumn(out, F.exp(score) if self.loss == "poisson" else score)


@dataclass(frozen=True)
class Boosting:
    """A model to be fitted. Losses: ``poisson`` (log link), ``squared_error``, ``logistic`` (outcomes 0 and 1)."""

    features: tuple[str, ...] = C.FEATURES
    target: str = C.TARGET
    key: str = "bene_id"
    loss: str = "poisson"
    learning_rate: float = 0.05
    max_iter: int = 600
    max_leaves: int = 15
    max_bins: int = 255
    min_leaf: int = 200
    l2: float = 1.0
    validation_share: float = 0.15
    patience: int = 30
    tolerance: float = 1e-7
    seed: int = 2024

    def __post_init__(self):
        if self.loss not in ("poisson", "squared_error", "logistic"):
            raise ValueError("loss must be 'poisson', 'squared_error' or 'logistic'")
        if not 2 <= self.max_bins <= 256:
            raise ValueError("bins are numbered by one byte")

    def fit(self, df: DataFrame) -> BoostedModel:
        return fit_together(df, [self])[0]

    @property
    def role(self) -> Column:
        """Rows without outcome take no part; a share of the others, dealt by a hash of the key, watches over the rounds."""
        watching = hash_share(self.key, f"valid|{self.seed}") < self.validation_share
        return F.when(F.col(self.target).isNull(), 0).when(watching, VALID).otherwise(TRAIN)

    def start(self, mean: float | None) -> float:
        mean = mean or 0.0
        if self.loss == "squared_error":
            return mean
        mean = max(mean, 1e-12)
        return math.log(mean) if self.loss == "poisson" else math.log(mean / max(1 - mean, 1e-12))

    def slopes(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the loss."""
        if self.loss == "squared_error":
            return score - y, np.ones(len(y))
        mean = np.exp(score) if self.loss == "poisson" else 1 / (1 + np.exp(-score))
        return mean - y, mean if self.loss == "poisson" else mean * (1 - mean)

    def losses(self, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        if self.loss == "squared_error":
            return (score - y) ** 2 / 2
        return np.exp(score) - y * score if self.loss == "poisson" else np.logaddexp(0, score) - y * score

    def finished(self, losses: list[float]) -> bool:
        """No loss of the last ``patience`` rounds is below the one before them."""
        if self.validation_share <= 0 or len(losses) <= self.patience:
            return False
        return min(losses[-self.patience:]) >= losses[-self.patience - 1] - self.tolerance


@dataclass(frozen=True)
class BoostedCost(Boosting):
    """Boosted next-year cost."""


@dataclass(frozen=True)
class BoostedClassifier(Boosting):
    """Boosted probability of the high-cost label."""

    target: str = C.LABEL
    loss: str = "logistic"
    max_iter: int = 500
    max_leaves: int = 31
    min_leaf: int = 100


# --- one tree ---

@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    left: tuple[float, ...]  # gradient, hessian and count of the left child
    can_go_on: tuple[bool, bool]  # whether the left and the right child are large enough to be split


def best_split(sums: np.ndarray, model: Boosting) -> Split | None:
    """Of (features, bins, 3) sums of gradients, hessians and counts; the first feature and bin win ties.

    Sums of the same rows in another order differ in their last digits, which must not decide between equal splits.
    """
    whole = sums[0].sum(axis=0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = whole - left
    fits = np.ones(left.shape[:2], bool)
    for side in (left, right):
        fits &= (np.round(side[:, :, 2]) >= model.min_leaf) & (side[:, :, 1] >= LEAST_HESSIAN)
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + model.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, worth(left) + worth(right) - worth(whole), 0.0)
    if not gain.size or gain.max() <= 1e-12 * max(1.0, float(worth(whole))):
        return None
    f, b = np.unravel_index(int((gain >= gain.max() * (1 - SAME_GAIN)).argmax()), gain.shape)
    go_on = tuple(bool(round(float(side[f, b, 2])) >= 2 * model.min_leaf) for side in (left, right))
    return Split(float(gain[f, b]), int(f), int(b), tuple(left[f, b].tolist()), go_on)


def packed_split(sums: np.ndarray, model: Boosting) -> np.ndarray:
    """Gradient, hessian and count of a node and, if it has one, its best split as numbers."""
    split = best_split(sums, model)
    more = [] if split is None else [split.gain, split.feature, split.bin, *split.left, *split.can_go_on]
    return np.array([*sums[0].sum(axis=0), *more])


def unpacked_split(body: np.ndarray) -> tuple[np.ndarray, Split | None]:
    gain, feature, bin_, *rest = body[3:] if len(body) > 3 else (0.0, 0, 0)
    return body[:3], Split(float(gain), int(feature), int(bin_), tuple(rest[:3]), (bool(rest[3]), bool(rest[4]))) if rest else None


def grown(model: Boosting) -> Generator[tuple[FlatTree, list[int]], dict[int, np.ndarray], FlatTree]:
    """Grow one tree: yields (tree so far, nodes whose splits are needed), is sent these, returns the tree of bins and steps.

    Leaves are split in the order of their gain. Where the order depends on children that are not known yet, the splits of all
    leaves that may be split before the tree is full are asked for at once; what turns out not to be split is a leaf again.
    """
    feature, threshold, left, right = [-1], [0], [0], [0]
    splits: dict[int, Split | None] = {}
    ends: dict[int, np.ndarray] = {}  # gradient, hessian and count of a node

    def so_far() -> FlatTree:
        return FlatTree(tuple(feature), tuple(threshold), tuple(left), tuple(right), (0.0,) * len(feature))

    def branch(node: int) -> None:
        split = splits[node]
        feature[node], threshold[node] = split.feature, split.bin
        left[node], right[node] = len(feature), len(feature) + 1
        for column in (feature, threshold, left, right):
            column += [-1 if column is feature else 0] * 2

    def halves(node: int) -> tuple[np.ndarray, np.ndarray]:
        part = np.array(splits[node].left)
        return part, ends[node] - part

    ends[0], splits[0] = unpacked_split((yield so_far(), [0])[0])
    while True:
        # Replay the order of gains as far as it is known.
        leaves, kept, wanting = {0}, set(), False
        while len(leaves) < model.max_leaves:
            open_ = [n for n in leaves if splits[n] is not None]
            if not open_:
                break
            node = max(open_, key=lambda n: (splits[n].gain, -n))
            last = len(leaves) + 1 == model.max_leaves
            if feature[node] < 0 and not last and any(splits[node].can_go_on):
                wanting = True
                break
            if feature[node] < 0:
                branch(node)
                for child, end in zip((left[node], right[node]), halves(node)):
                    ends[child], splits[child] = end, None
            kept.add(node)
            leaves.remove(node)
            if last:
                break
            leaves |= {left[node], right[node]}
        if not wanting:
            break
        ahead = sorted((n for n in leaves if splits[n] is not None and feature[n] < 0 and any(splits[n].can_go_on)),
                       key=lambda n: (-splits[n].gain, n))
        asked = []
        for node in ahead[:model.max_leaves - len(leaves)]:
            branch(node)
            for child, end, on in zip((left[node], right[node]), halves(node), splits[node].can_go_on):
                ends[child], splits[child] = end, None
                asked += [child] * on
        found = yield so_far(), asked
        for child in asked:
            ends[child], splits[child] = unpacked_split(found[child])

    def value(end: np.ndarray) -> float:
        return float(-model.learning_rate * end[0] / (end[1] + model.l2)) if end[1] + model.l2 > 0 else 0.0

    out: list[list] = [[], [], [], [], []]

    def copy(node: int) -> int:
        at = len(out[0])
        for column, x in zip(out, (-1, 0, 0, 0, 0.0)):
            column.append(x)
        if node not in kept:
            out[4][at] = value(ends[node])
            return at
        out[0][at], out[1][at] = feature[node], threshold[node]
        out[2][at], out[3][at] = copy(left[node]), copy(right[node])
        return at

    copy(0)
    return FlatTree(*(tuple(c) for c in out))


# --- all models over the blocks ---

def cells(names: list[str]):
    """Per feature the values that agree in their 12 leading binary digits: number, least and greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(numbers(batch, names)):
                x = np.sort(x[np.isfinite(x)]) + 0.0  # no negative zero
                first = np.flatnonzero(np.diff(x.view(np.int64) >> 40, prepend=-1)) if len(x) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(x)) - 1 if len(x) else first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), i, np.int32)), pa.array(x[first].view(np.int64) >> 40),
                                                  pa.array(last - first + 1), pa.array(x[first]), pa.array(x[last])],
                                                 ["feature", "cell", "n", "low", "high"])

    return run


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cuts in the middle between neighbouring values: between all cells of a feature that has few, else at even ranks.

    A cell is the values that agree in 12 leading binary digits, so counts of cells add up to the same cuts however the rows lie.
    """
    if not features:
        return []
    kinds = "feature int, cell long, n long, low double, high double"
    found = df.select(*[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(cells(list(features)), kinds)
    found = found.groupBy("feature", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    each = W.partitionBy("feature")
    up = each.orderBy("low")
    ranked = found.select(
        "feature", "low", "n", F.sum("n").over(up).alias("upto"), F.sum("n").over(each).alias("all"), F.count("*").over(each).alias("cells"),
        F.row_number().over(up).alias("at"), ((F.col("high") + F.lead("low").over(up)) / 2).alias("cut"))
    step = F.floor(F.col("upto") * bins / F.col("all")) > F.floor((F.col("upto") - F.col("n")) * bins / F.col("all"))
    kept = ranked.where(F.col("cut").isNotNull() & ((F.col("cells") <= bins) | step)).select("feature", "cut")  # bins rows a feature
    out = [np.zeros(0)] * len(features)
    for i, part in kept.toPandas().groupby("feature"):
        out[i] = np.sort(part.cut.to_numpy())
    return out


@dataclass
class Progress:
    """A model on its way: its place among roles, targets and features, trees in bins, the tree that grows."""

    model: Boosting
    role: int
    target: int
    columns: list[int]
    start: float
    row: int  # its place among the stored scores
    trees: list[FlatTree] = field(default_factory=list)
    stored: int = 0  # trees that the stored scores include
    losses: list[float] = field(default_factory=list)
    growing: Generator | None = None
    tree: FlatTree | None = None
    nodes: list[int] = field(default_factory=list)

    def begin(self) -> None:
        self.growing = grown(self.model)
        self.tree, self.nodes = next(self.growing)

    def feed(self, found: dict[int, np.ndarray]) -> bool:
        """Whether the model goes on."""
        if -1 in found:
            self.losses.append(float(found[-1][0] / max(found[-1][1], 1.0)))
            if self.model.finished(self.losses):
                return False
        try:
            self.tree, self.nodes = self.growing.send({n: found.get(n, np.zeros(3)) for n in self.nodes})
        except StopIteration as end:
            self.trees.append(end.value)
            if len(self.trees) >= self.model.max_iter or end.value.leaves == 1:
                return False
            self.begin()
        return True


def read(record: dict, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = record["n"]
    codes, packs, roles = (np.frombuffer(record[c], np.uint8) for c in ("codes", "packs", "roles"))
    return (codes.reshape(n_features, n), packs.reshape(-1, n), np.frombuffer(record["targets"]).reshape(-1, n), roles.reshape(-1, n),
            np.frombuffer(record["scores"]).reshape(-1, n))


def joined(n_features: int):
    """Several records as one."""

    def run(part: list[dict]) -> dict:
        arrays = zip(*(read(record, n_features) for record in part))
        names = ("codes", "packs", "targets", "roles", "scores")
        return {"n": sum(record["n"] for record in part), **{c: np.concatenate(a, axis=1).tobytes() for c, a in zip(names, arrays)}}

    return run


def moved(score: np.ndarray, codes: np.ndarray, trees: list[FlatTree]) -> np.ndarray:
    for tree in trees:
        score = score + np.array(tree.step)[landed(tree, codes)]
    return score


def bundles(widths: Sequence[int]) -> list[list[int]]:
    """Features by the byte that holds them: the bins of several make one number while their cells are no more than ``BUNDLE``."""
    out: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: (-widths[f], f)):
        room = [b for b in out if math.prod(widths[x] for x in b) * widths[f] <= BUNDLE]
        if room:
            room[0].append(f)
        else:
            out.append([f])
    return out


def bundled(codes: np.ndarray, widths: Sequence[int], held: list[list[int]]) -> np.ndarray:
    """The numbers of the bundles for each column of ``codes`` (features, rows); the last feature of a bundle counts single steps."""
    out = np.zeros((len(held), codes.shape[1]), np.int64)
    for row, features in zip(out, held):
        for f in features:
            row *= widths[f]
            row += codes[f]
    return out.astype(np.uint8)


def needed(columns: Sequence[int], widths: Sequence[int], held: list[list[int]]) -> list[tuple[int, int]]:
    """The bundles that hold any of the features ``columns``, each with its cells."""
    return [(k, math.prod(widths[f] for f in b)) for k, b in enumerate(held) if set(b) & set(columns)]


def node_sums(n_features: int, widths: list[int], held: list[list[int]], work: list[tuple[int, Progress, list[FlatTree]]]):
    """Per model and asked node the sums of a block, (3, cells), bundle by bundle; part -1 is the loss of the watching rows.

    ``widths``: the bins of each feature; ``held``: the features of each bundle. One count of a bundle serves all its features.
    """
    work = [(i, p.model, p.role, p.target, p.row, np.array(p.columns, np.int64), needed(p.columns, widths, held), p.tree, p.nodes, trees)
            for i, p, trees in work]

    def sums(record: dict) -> Iterator[tuple[int, int, np.ndarray]]:
        codes, packs, targets, roles, scores = read(record, n_features)
        for i, model, role, target, row, columns, use, tree, nodes, trees in work:
            mine = codes[columns]
            score, y, role_of = moved(scores[row], mine, trees), targets[target], roles[role]
            if nodes == [0]:
                rows = np.flatnonzero(role_of == VALID)
                yield i, -1, np.array([model.losses(y[rows], score[rows]).sum(), len(rows)])
            slot = np.full(len(tree.feature), -1, np.int16)
            slot[nodes] = np.arange(len(nodes))
            at = np.where(role_of == TRAIN, slot[landed(tree, mine)], np.int16(-1))
            rows = np.argsort(at, kind="stable")  # a radix sort
            rows = rows[np.searchsorted(at[rows], 0):]
            first, second = model.slopes(y[rows], score[rows])
            at = at[rows].astype(np.int64) * BUNDLE
            found, upto = np.empty((len(nodes), 3, sum(size for _, size in use))), 0
            for k, size in use:
                cell = at + packs[k].take(rows)
                for j, weight in enumerate((first, second, None)):
                    count = np.bincount(cell, weight, len(nodes) * BUNDLE).reshape(len(nodes), BUNDLE)
                    found[:, j, upto:upto + size] = count[:, :size]
                upto += size
            for k, node in enumerate(nodes):
                yield i, node, found[k]

    return lambda record: ((i, part, body.reshape(-1)) for i, part, body in sums(record))


def feature_sums(widths: list[int], held: list[list[int]], work: list[tuple[int, Progress]]):
    """What a task sends of the sums of a node: those of the bundles added up to (cells, 3), feature by feature."""
    work = {i: p.columns for i, p in work}
    known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def cells(columns: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """For each cell of a bundle and feature in it: the cell of the feature, the cell of the bundle; and all cells of features."""
        first = dict(zip(columns, np.concatenate([[0], np.cumsum([widths[c] for c in columns])])))
        to, of, upto = [], [], 0
        for k, size in needed(columns, widths, held):
            cell, step = np.arange(size), 1
            for f in reversed(held[k]):
                if f in first:
                    to.append(first[f] + cell // step % widths[f])
                    of.append(upto + cell)
                step *= widths[f]
            upto += size
        return np.concatenate(to), np.concatenate(of), sum(widths[c] for c in columns)

    def folded(i: int, part: int, body: np.ndarray) -> np.ndarray:
        if part < 0:
            return body
        if i not in known:
            known[i] = cells(work[i])
        to, of, n = known[i]
        return np.stack([np.bincount(to, x[of], n) for x in body.reshape(3, -1)], axis=1).reshape(-1)

    return folded


def node_splits(widths: list[int], work: list[tuple[int, Progress]]):
    """What reaches the driver of the whole sums of a node: its end and best split."""
    work = {i: (p.model, [widths[c] for c in p.columns]) for i, p in work}

    def split(i: int, part: int, body: np.ndarray) -> np.ndarray:
        if part < 0:
            return body
        model, width = work[i]
        sums = np.zeros((len(width), max(model.max_bins, *width), 3))
        sums[np.repeat(np.arange(len(width)), width), np.concatenate([np.arange(w) for w in width])] = body.reshape(-1, 3)
        return packed_split(sums, model)

    return split


def rescored(blocks: DataFrame, n_features: int, models: list[Progress]) -> DataFrame:
    """The blocks with the scores that all trees so far give in these models, stored; the table before is deleted."""
    work = [(p.row, np.array(p.columns, np.int64), p.trees[p.stored:]) for p in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = []
            for record in records([batch]):
                codes, _, _, _, scores = read(record, n_features)
                after.append(np.stack([moved(scores[row], codes[columns], trees) for row, columns, trees in work]).tobytes())
            yield batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.array(after, pa.binary()))

    out = materialize(blocks.mapInArrow(run, blocks.schema), "boost")
    for row, p in enumerate(models):
        p.row, p.stored = row, len(p.trees)
    release(blocks)
    return out


def fit_together(df: DataFrame, models: Sequence[Boosting], store_every: int | None = None) -> list[BoostedModel]:
    """Fit all ``models`` on the rows of ``df``, in common passes.

    Rows are read once, binned once and stored. Nulls and NaN in a feature count as less than every value; rows without a target
    take no part in that model. Scores are stored every ``store_every`` trees of the quickest model (ten, five where several tasks
    share the rows), so that a pass walks a few trees only and a lost executor costs re-reads. A fit ends after its rounds, when the watching rows say so, or with a tree
    that has no split. Without rows a model is the constant of its loss.
    """
    if not models:
        return []
    bins = {m.max_bins for m in models}
    if len(bins) > 1:
        raise ValueError("models that are fitted together share their bins")
    features = list(dict.fromkeys(f for m in models for f in m.features))
    targets = list(dict.fromkeys(m.target for m in models))
    kinds = {(m.target, m.key, m.seed, m.validation_share): m.role for m in models}
    roles, role_names = list(kinds), [f"_role{i}" for i in range(len(kinds))]
    rows = materialize(df.select(*[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)],
                                 *[F.col(t).cast("double").alias(f"_t{i}") for i, t in enumerate(targets)],
                                 *[c.cast("int").alias(n) for n, c in zip(role_names, kinds.values())]), "boost")
    names, target_names = [f"_f{i}" for i in range(len(features))], [f"_t{i}" for i in range(len(targets))]
    cuts = bin_cuts(rows, names, bins.pop())
    at = [roles.index((m.target, m.key, m.seed, m.validation_share)) for m in models]
    of = [targets.index(m.target) for m in models]
    n, *means = rows.agg(F.count("*"), *[F.avg(F.when(F.col(f"_role{r}") == TRAIN, F.col(f"_t{t}"))) for r, t in zip(at, of)]).first()
    state = [Progress(m, r, t, [features.index(f) for f in m.features], m.start(mean), i)
             for i, (m, r, t, mean) in enumerate(zip(models, at, of, means))]
    widths = [len(c) + 1 for c in cuts]
    held = bundles(widths)
    starts = np.array([[p.start] for p in state])

    def pack(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = np.nan_to_num(numbers(part, names), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x)]) if names else np.zeros((0, part.num_rows))
        return {"codes": codes.astype(np.uint8), "packs": bundled(codes, widths, held), "targets": np.nan_to_num(numbers(part, target_names)),
                "roles": numbers(part, role_names).astype(np.uint8), "scores": np.repeat(starts, part.num_rows, axis=1)}

    # every task of a pass shuffles sums: no more tasks than cores
    tasks = min(n * len(models) // PASS_ROWS + 1, df.sparkSession.sparkContext.defaultParallelism)
    blocks = packed(rows, pack, ["codes", "packs", "targets", "roles", "scores"], "boost", n, tasks)
    release(rows)
    held_blocks = kept(blocks, joined(len(features)))
    every = store_every or (10 if tasks == 1 else 5)
    active = {i: p for i, p in enumerate(state) if p.model.max_iter > 0 and p.columns and means[i] is not None}
    for p in active.values():
        p.begin()
    while active:
        at_work = list(active.items())
        found = total(held_blocks, node_sums(len(features), widths, held, [(i, p, p.trees[p.stored:]) for i, p in at_work]), n, 0,
                      node_splits(widths, at_work), tasks, sum(len(p.nodes) for p in active.values()), feature_sums(widths, held, at_work))
        for i, p in at_work:
            if not p.feed({part: body for (model, part), body in found.items() if model == i}):
                del active[i]
        if active and max(len(p.trees) - p.stored for p in active.values()) >= every:
            held_blocks.unpersist()
            blocks = rescored(blocks, len(features), list(active.values()))
            held_blocks = kept(blocks, joined(len(features)))
    held_blocks.unpersist()
    release(blocks)

    def real(p: Progress, tree: FlatTree) -> FlatTree:
        threshold = tuple(float(cuts[p.columns[f]][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold))
        return FlatTree(tree.feature, threshold, tree.left, tree.right, tree.step)

    return [BoostedModel(tuple(p.model.features), p.start, [real(p, t) for t in p.trees], p.model.loss, p.losses) for p in state]
