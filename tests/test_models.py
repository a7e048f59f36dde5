"""Fitted models on generated data with known signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.ml.baselines import CredibilityRate, NaivePersistence
from actuspark.ml.boosting import BoostedClassifier, BoostedCost, Boosting, FlatTree, bin_cuts, fit_together, landed
from actuspark.ml.linear import LogisticClassifier, TweedieGLM
from actuspark.ml.registry import score_all
from actuspark.operators import explain

rng = np.random.default_rng(3)
FEATURES = ("x1", "x2", "x3")


@pytest.fixture(scope="module")
def signal(spark):
    n = 3000
    x = rng.normal(0, 1, (n, 3))
    mu = np.exp(6 + 0.5 * x[:, 0] - 0.3 * x[:, 1])
    pdf = pd.DataFrame({"bene_id": [f"m{i}" for i in range(n)], "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2],
                        "y": rng.gamma(2, mu / 2), "mu": mu})
    pdf["c"] = (rng.random(n) < 1 / (1 + np.exp(2 - 1.5 * x[:, 0]))).astype(int)
    return spark.createDataFrame(pdf).cache(), pdf


def test_rows_end_where_a_walk_of_each_row_ends():
    """Also in trees of more nodes than a byte counts, in trees of one leaf and for rows without a value."""
    draw = np.random.default_rng(7)
    for splits in (0, 1, 14, 200):
        feature, threshold, left, right, leaves = [-1], [0.0], [0], [0], [0]
        for _ in range(splits):
            at = leaves.pop(draw.integers(len(leaves)))
            feature[at], threshold[at] = int(draw.integers(3)), float(draw.integers(9))
            left[at], right[at] = len(feature), len(feature) + 1
            leaves += [left[at], right[at]]
            for column in (feature, threshold, left, right):
                column += [-1 if column is feature else 0] * 2
        tree = FlatTree(tuple(feature), tuple(threshold), tuple(left), tuple(right), (0.0,) * len(feature))
        codes = draw.integers(0, 10, (3, 300))
        for x in (codes.astype(np.uint8), np.where(draw.random(codes.shape) < 0.1, -np.inf, codes)):
            ends = []
            for row in x.T:
                node = 0
                while feature[node] >= 0:
                    node = left[node] if row[feature[node]] <= threshold[node] else right[node]
                ends.append(node)
            assert landed(tree, x).tolist() == ends


def test_naive_persistence(spark):
    df = spark.createDataFrame([("a", 100.0, 150.0), ("b", 0.0, 50.0), ("c", 300.0, 400.0)],
                               "bene_id string, paid_total double, target_paid double")
    m = NaivePersistence().fit(df)
    assert m.trend == pytest.approx(1.5) and m.floor == pytest.approx(50.0)
    got = {r["bene_id"]: r["prediction"] for r in m.transform(df).collect()}
    assert got == {"a": 150.0, "b": 50.0, "c": 450.0}


def test_credibility_rate_and_unknown_cells(spark):
    rows = [(70.0, 1, 0, 100.0)] * 200 + [(80.0, 0, 0, 300.0)] * 200
    df = spark.createDataFrame(rows, "age double, is_female int, esrd int, target_paid double")
    m = CredibilityRate().fit(df)
    assert m.mean == pytest.approx(200.0)
    new = spark.createDataFrame([(70.0, 1, 0), (80.0, 0, 0), (50.0, 1, 1), (0.0, 0, 0)], "age double, is_female int, esrd int")
    got = [r["prediction"] for r in m.transform(new).orderBy(F.desc("age")).collect()]
    assert got == pytest.approx([250.0, 150.0, 200.0, 200.0])


def test_glm_recovers_coefficients(signal):
    df, _ = signal
    m = TweedieGLM(FEATURES, "y", alpha=1e-6).fit(df)
    assert np.allclose(m.coefficients.toArray(), [0.5, -0.3, 0.0], atol=0.06)
    total = m.transform(df).agg(F.sum("prediction"), F.sum("y")).first()
    assert total[0] == pytest.approx(total[1], rel=0.02)


@pytest.mark.parametrize("alpha", [0.0, 0.01, 5.0])
def test_glm_solves_the_penalised_mean_deviance(signal, alpha):
    """At the optimum the gradient of half the mean deviance equals -alpha * beta."""
    df, pdf = signal
    m = TweedieGLM(FEATURES, "y", alpha=alpha).fit(df)
    assert m.gradient < 1e-8
    mu = m.transform(df).toPandas().set_index("bene_id").prediction[pdf.bene_id].to_numpy()
    x = ((pdf[list(FEATURES)] - pdf[list(FEATURES)].mean()) / pdf[list(FEATURES)].std(ddof=0)).to_numpy()
    slope = (pdf.y.to_numpy() - mu) * mu**-0.5
    assert np.allclose((x * slope[:, None]).mean(axis=0), alpha * m.coefficients.toArray(), atol=1e-6) and abs(slope.mean()) < 1e-6


def test_logistic_solves_the_penalised_loss(signal):
    df, pdf = signal
    m = LogisticClassifier(FEATURES, "c", c=0.02).fit(df)
    p = m.transform(df).toPandas().set_index("bene_id").prediction[pdf.bene_id].to_numpy()
    x = ((pdf[list(FEATURES)] - pdf[list(FEATURES)].mean()) / pdf[list(FEATURES)].std(ddof=0)).to_numpy()
    slope = pdf.c.to_numpy() - p
    assert m.gradient < 1e-8 and abs(slope.sum()) < 1e-5
    assert np.allclose(0.02 * (x * slope[:, None]).sum(axis=0), m.coefficients.toArray(), atol=1e-6)


def test_linear_fits_of_edge_tables(spark):
    rows = [(1.0, 2.0, 10.0, 1), (None, 2.0, 30.0, 0), (3.0, 2.0, 20.0, 1), (4.0, 2.0, 0.0, 0), (5.0, 2.0, None, None)]
    df = spark.createDataFrame(rows, "a double, const double, y double, c int")
    for est in (TweedieGLM(("a", "const"), "y"), LogisticClassifier(("a", "const"), "c")):
        m = est.fit(df)
        assert m.weights[1] == 0.0 and m.transform(df).where("prediction > 0").count() == 5
        assert est.fit(df.limit(0)).transform(df).select("prediction").distinct().count() == 1


def poisson_deviance(y, mu):
    return 2 * np.mean(np.where(y > 0, y * np.log(np.maximum(y, 1e-12) / mu), 0) - y + mu)


@pytest.mark.parametrize("loss", ["poisson", "squared_error"])
def test_boosted_cost_learns_and_keeps_the_total(signal, loss):
    df, pdf = signal
    m = fit_together(df, [BoostedCost(FEATURES, "y", loss=loss, max_iter=12, learning_rate=0.3, min_leaf=50, validation_share=0.1)], 5)[0]
    assert len(m.trees) == 12 and len(m.validation_losses) == 12 and m.validation_losses[-1] < m.validation_losses[0]
    out = m.transform(df).toPandas()
    assert out.prediction.sum() == pytest.approx(out.y.sum(), rel=0.05)
    assert np.corrcoef(out.prediction, out.mu)[0, 1] > 0.9
    if loss == "poisson":
        assert poisson_deviance(out.y, out.prediction) < 0.8 * poisson_deviance(out.y, np.full(len(out), out.y.mean()))


def plain_boosting(pdf, m, cuts):
    """Leaf-wise boosting as written in a textbook: every split of every leaf is tried on the rows themselves."""
    y = pdf[m.target].to_numpy().astype(float)
    codes = [np.searchsorted(c, pdf[f].fillna(-np.inf)) for c, f in zip(cuts, m.features)]
    score, sizes = np.full(len(y), m.start(y.mean())), []
    for _ in range(m.max_iter):
        mu = {"poisson": np.exp(score), "logistic": 1 / (1 + np.exp(-score)), "squared_error": score}[m.loss]
        g, h = mu - y, {"poisson": mu, "logistic": mu * (1 - mu), "squared_error": np.ones(len(y))}[m.loss]

        def worth(rows):
            return g[rows].sum() ** 2 / (h[rows].sum() + m.l2)

        def best(rows):
            found = (0.0, None)
            for code, cut in zip(codes, cuts):
                for b in range(len(cut)):
                    low, high = rows[code[rows] <= b], rows[code[rows] > b]
                    if min(len(low), len(high)) >= m.min_leaf:
                        gain = worth(low) + worth(high) - worth(rows)
                        if gain > found[0] * (1 + 1e-9):
                            found = (gain, (low, high))
            return found

        leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < m.max_leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
            if leaves[k][0][1] is None:
                break
            leaves[k:k + 1] = [(best(part), part) for part in leaves[k][0][1]]
        sizes.append(len(leaves))
        for _, rows in leaves:
            score[rows] -= m.learning_rate * g[rows].sum() / (h[rows].sum() + m.l2)
    return score, sizes


@pytest.mark.parametrize("loss, leaves", [("poisson", 15), ("squared_error", 6), ("logistic", 31)])
def test_leaf_wise_growth_equals_plain_boosting(signal, loss, leaves):
    df, pdf = signal
    target = "c" if loss == "logistic" else "y"
    m = Boosting(FEATURES, target, loss=loss, max_iter=3, learning_rate=0.3, min_leaf=40, max_leaves=leaves, max_bins=40, validation_share=0.0)
    fitted = m.fit(df)
    score, sizes = plain_boosting(pdf, m, bin_cuts(df, FEATURES, 40))
    assert [t.leaves for t in fitted.trees] == sizes and max(sizes) == leaves
    got = fitted.transform(df).toPandas().set_index("bene_id").prediction[pdf.bene_id].to_numpy()
    want = {"poisson": np.exp(score), "logistic": 1 / (1 + np.exp(-score)), "squared_error": score}[loss]
    assert np.allclose(got, want, rtol=1e-9)


def test_models_that_grow_together_are_those_that_grow_alone(signal):
    df, _ = signal
    base = dict(max_iter=4, learning_rate=0.3, min_leaf=60, max_bins=30)
    plan = [BoostedCost(FEATURES, "y", **base), BoostedCost(("x2", "x3"), "y", seed=7, **base), BoostedClassifier(FEATURES, "c", **base),
            BoostedCost(FEATURES, "y", loss="squared_error", **{**base, "max_iter": 2})]
    for one, m in zip(plan, fit_together(df, plan, 2)):
        alone = one.fit(df)
        assert [(t.feature, t.threshold) for t in m.trees] == [(t.feature, t.threshold) for t in alone.trees]
        assert all(np.allclose(t.step, a.step) for t, a in zip(m.trees, alone.trees))
        assert np.allclose(m.validation_losses, alone.validation_losses)


def test_first_tree_by_hand(signal):
    """One round: leaves are Newton steps with the ridge of 1."""
    df, pdf = signal
    m = BoostedCost(FEATURES, "y", max_iter=1, learning_rate=1.0, min_leaf=50, validation_share=0.0, l2=1.0).fit(df)
    out = m.transform(df).toPandas()
    start = pdf.y.mean()
    for value, leaf in out.groupby(out.prediction.round(6)):
        step = (leaf.y - start).sum() / (start * len(leaf) + 1.0)
        assert value == pytest.approx(start * np.exp(step), rel=1e-6)
    assert out.prediction.nunique() <= 15


def test_early_stopping(signal):
    df, _ = signal
    m = BoostedCost(("x3",), "y", learning_rate=1.0, min_leaf=20, patience=2, max_iter=60).fit(df)
    assert 2 <= len(m.trees) < 60
    assert min(m.validation_losses[-2:]) >= m.validation_losses[-3] - 1e-7


def test_boosting_edge_tables(spark):
    rows = [(f"k{i}", None if i % 5 == 0 else float(i % 3), float("nan") if i % 7 == 0 else 1.0, None, None if i == 3 else float(i % 4))
            for i in range(60)]
    df = spark.createDataFrame(rows, "bene_id string, a double, b double, nothing double, y double")
    m = BoostedCost(("a", "b", "nothing"), "y", max_iter=3, min_leaf=5, learning_rate=0.5, validation_share=0.0).fit(df)
    assert m.trees and {f for t in m.trees for f in t.feature} <= {-1, 0, 1}
    assert m.transform(df).where("prediction > 0").count() == 60
    empty = BoostedCost(("a",), "y").fit(df.limit(0))
    assert not empty.trees and empty.transform(df).count() == 60
    same = BoostedCost(("nothing",), "y").fit(df)
    assert len(same.trees) == 1 and same.trees[0].leaves == 1
    with pytest.raises(ValueError):
        BoostedCost(("a",), "y", loss="huber")
    with pytest.raises(ValueError):
        fit_together(df, [BoostedCost(("a",), "y"), BoostedCost(("a",), "y", max_bins=9)])


def test_classifiers_rank_the_label(signal):
    df, pdf = signal
    logit = LogisticClassifier(FEATURES, "c").fit(df)
    boosted = BoostedClassifier(FEATURES, "c", max_iter=5, learning_rate=0.3, min_leaf=50).fit(df)
    long = score_all(df, {"l": logit, "b": boosted}, ["bene_id", "c"]).toPandas()
    for _, d in long.groupby("model"):
        assert d.prediction.between(0, 1).all()
        assert d[d.c == 1].prediction.mean() > d[d.c == 0].prediction.mean() + 0.1


class Linear:
    """A stand-in model: 3 * x1 + x2."""

    def transform(self, df, out="prediction"):
        return df.withColumn(out, 3 * F.col("x1") + F.col("x2"))


def test_importance_and_dependence(spark):
    n = 500
    pdf = pd.DataFrame({"id": range(n), "x1": rng.normal(size=n), "x2": rng.normal(size=n), "x3": rng.integers(0, 3, n) * 1.0})
    pdf["y"] = 3 * pdf.x1 + pdf.x2
    sample = explain.explain_sample(spark.createDataFrame(pdf), "id", size=400)
    assert sample.count() == 400
    imp = {r["feature"]: r for r in explain.permutation_importance(Linear(), sample, FEATURES, "y", "id").collect()}
    assert imp["x1"]["importance"] > imp["x2"]["importance"] > 0.1 and imp["x3"]["importance"] == pytest.approx(0)
    assert explain.top_features(explain.permutation_importance(Linear(), sample, FEATURES, "y", "id"), 2) == ["x1", "x2"]
    pd_ = explain.partial_dependence(Linear(), sample, ["x1", "x3"], FEATURES).toPandas()
    line = pd_[pd_.feature == "x1"].sort_values("value")
    assert len(line) == 20 and np.allclose(np.diff(line.avg_pred) / np.diff(line.value), 3)
    assert sorted(pd_[pd_.feature == "x3"].value) == [0.0, 1.0, 2.0]


class Opaque:
    """A boosted model behind the general path: rows are copied and scored again."""

    def __init__(self, model):
        self.model = model

    def transform(self, df, out="prediction"):
        return self.model.transform(df, out)


@pytest.mark.parametrize("loss, target", [("poisson", "y"), ("logistic", "c")])
def test_trees_are_explained_as_by_scoring_again(signal, loss, target):
    df, _ = signal
    model = Boosting(FEATURES, target, loss=loss, max_iter=8, learning_rate=0.3, min_leaf=100, validation_share=0.0).fit(df)
    sample = explain.explain_sample(df.select("bene_id", F.col(target).alias("out"), *FEATURES, F.lit(1.0).alias("idle")), "bene_id", size=700)
    inputs = (*FEATURES, "idle")
    fast, slow = (explain.permutation_importance(m, sample, inputs, "out", "bene_id", 2).toPandas().set_index("feature")
                  for m in (model, Opaque(model)))
    assert set(fast.index) == set(inputs) and np.allclose(fast, slow.loc[fast.index], atol=1e-9)
    fast, slow = (explain.partial_dependence(m, sample, ["x1", "x3"], FEATURES).toPandas().sort_values(["feature", "value"])
                  for m in (model, Opaque(model)))
    assert len(fast) == 40 and np.allclose(fast[["value", "avg_pred"]], slow[["value", "avg_pred"]])


def test_input_shocks(spark):
    df = spark.createDataFrame([(100.0, 4.0), (300.0, 1.0)], "paid_total double, n_chronic double")

    class Total:
        def transform(self, frame, out="prediction"):
            return frame.withColumn(out, F.col("paid_total") + 10 * F.col("n_chronic"))

    got = {r["test"]: r["mean_pred_change"] for r in explain.input_shocks(
        Total(), df, ["paid_total", "n_chronic"],
        {"up": {"paid_total": F.col("paid_total") * 1.1}, "more": explain.plus_one("n_chronic")}).collect()}
    assert got["up"] == pytest.approx(40 / 450) and got["more"] == pytest.approx(20 / 450)
    assert set(explain.standard_shocks()) and C.TARGET not in C.FEATURES


def test_only_ends_and_splits_of_nodes_reach_the_driver(signal, monkeypatch):
    """Also from several tasks with a shuffle between, which gives the same trees."""
    from actuspark.ml import boosting

    df, _ = signal
    df, plan, sent = df.repartition(8), [BoostedCost(FEATURES, "y", max_iter=3, min_leaf=20), BoostedClassifier(FEATURES, "c", max_iter=3, min_leaf=20)], []
    whole = boosting.total

    def watched(*args):
        found = whole(*args)
        sent.append(max(len(body) for body in found.values()))
        return found

    monkeypatch.setattr(boosting, "total", watched)
    alone = fit_together(df, plan)
    monkeypatch.setattr(boosting, "PASS_ROWS", 1000)
    spread = fit_together(df, plan)
    assert max(sent) <= 11
    for a, b in zip(alone, spread):
        assert [(t.feature, t.threshold, t.left) for t in a.trees] == [(t.feature, t.threshold, t.left) for t in b.trees]
        assert np.allclose([s for t in a.trees for s in t.step], [s for t in b.trees for s in t.step], rtol=1e-9)
        assert sum(t.leaves for t in a.trees) > 6
