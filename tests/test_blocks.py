"""What a pass over blocks sends to the driver."""

import numpy as np
from pyspark.sql import functions as F

from actuspark.ml import blocks, boosting
from actuspark.ml.linear import block_sums, logistic


def test_a_newton_pass_sends_the_driver_one_sum_whatever_the_tasks(spark, monkeypatch):
    """Sums of 45 weights over some 90 tasks are 1.5 MB: they are added up before they reach the driver."""
    width, size = 45, 45 * 46 + 1
    x = np.random.default_rng(3).normal(size=(width, 30))
    body = [(30, x.tobytes(), np.zeros(30).tobytes())] * 90
    table = spark.createDataFrame(body, "n int, x binary, y binary").repartition(90)
    fetched = []
    plain = type(table).toArrow
    monkeypatch.setattr(type(table), "toArrow", lambda self: (fetched.append(plain(self)), fetched[-1])[1])
    found = blocks.total(table, block_sums(logistic, width, np.zeros(width)), 90 * blocks.TASK_ROWS, size)
    _, first, second = logistic(np.zeros(30), np.zeros(30))
    assert fetched[0].num_rows == 1
    np.testing.assert_allclose(found[0, 0][1: width + 1], 90 * (x @ first))
    np.testing.assert_allclose(found[0, 0][width + 1:].reshape(width, width), 90 * (x * second) @ x.T)


def test_tasks_of_a_pass_get_as_many_rows_each_however_the_rows_lay(spark):
    rows = spark.range(0, 4000, 1, 1).select(F.col("id").cast("double").alias("x"))
    pack = lambda part: {"x": blocks.numbers(part, ["x"])}
    table = blocks.packed(rows, pack, ["x"], "test", 4000, 4)
    held = blocks.kept(table, lambda part: {"n": sum(r["n"] for r in part), "x": b"".join(bytes(r["x"]) for r in part)})
    counts = [c for c in held.mapPartitions(lambda part: [sum(r["n"] for r in part)]).collect() if c]
    assert len(counts) == 4 and max(counts) - min(counts) <= 4
    found = blocks.total(held, lambda r: iter([(0, r["n"] % 2, np.frombuffer(r["x"]).sum(keepdims=True))]), 4000, 0, lambda i, part, body: body, 4, 2)
    assert sum(float(body[0]) for body in found.values()) == 4000 * 3999 / 2
    held.unpersist()


def test_sums_of_bundled_features_are_those_of_each_feature():
    """Also where a model leaves out features that share a byte with its own."""
    draw = np.random.default_rng(5)
    widths, n = [2, 256, 3, 1, 13, 2, 7, 40, 2], 500
    codes = np.stack([draw.integers(0, w, n) for w in widths]).astype(np.uint8)
    held = boosting.bundles(widths)
    assert sorted(f for b in held for f in b) == list(range(len(widths))) and len(held) < len(widths) - 3
    tree = boosting.FlatTree((4, -1, -1), (5, 0, 0), (1, 0, 0), (2, 0, 0), (0.0,) * 3)
    y, score, role = draw.gamma(2, 50, n), draw.normal(4, 0.1, (2, n)), draw.choice([0, boosting.TRAIN, boosting.VALID], n).astype(np.uint8)
    plan = []
    for i, columns in enumerate(([0, 1, 2, 3, 4, 5, 6, 7, 8], [8, 4, 1])):
        plan.append(boosting.Progress(boosting.BoostedCost(tuple("abcdefghi"[c] for c in columns)), 0, 0, columns, 0.0, i))
        plan[-1].tree, plan[-1].nodes = tree if i == 0 else boosting.FlatTree((1, -1, -1), (5, 0, 0), (1, 0, 0), (2, 0, 0), (0.0,) * 3), [1, 2]
    record = {"n": n, "codes": codes.tobytes(), "packs": boosting.bundled(codes, widths, held).tobytes(), "targets": y.tobytes(),
              "roles": role.tobytes(), "scores": score.tobytes()}
    work = list(enumerate(plan))
    send = boosting.feature_sums(widths, held, work)
    got = {(i, part): send(i, part, body) for i, part, body in boosting.node_sums(len(widths), widths, held, [(i, p, []) for i, p in work])(record)}
    assert set(got) == {(i, node) for i in (0, 1) for node in (1, 2)}
    for (i, node), body in got.items():
        rows = (role == boosting.TRAIN) & ((codes[4] <= 5) == (node == 1))
        slopes = [*plan[i].model.slopes(y[rows], score[i][rows]), np.ones(rows.sum())]
        want = [[np.bincount(codes[c][rows], s, widths[c]) for s in slopes] for c in plan[i].columns]
        np.testing.assert_allclose(body.reshape(-1, 3), np.concatenate([np.transpose(w) for w in want]), rtol=1e-12)


def test_the_order_of_sums_does_not_decide_between_equal_splits():
    sums = np.zeros((3, 2, 3))
    sums[:] = [[-30.1, 40.0, 300], [30.2, 50.0, 310]]
    sums[1] *= 1 + 4e-16  # the same rows added up in another order
    sums[2, :, 0] /= 2
    model = boosting.BoostedCost(("a", "b", "c"))
    assert boosting.best_split(sums, model).feature == 0
    assert boosting.best_split(sums[::-1], model).feature == 1


def test_joined_records_have_the_sums_of_their_parts():
    draw, widths = np.random.default_rng(9), [3, 2, 5]
    held = boosting.bundles(widths)
    p = boosting.Progress(boosting.BoostedCost(("a", "b", "c")), 0, 0, [0, 1, 2], 0.0, 0)
    p.tree, p.nodes = boosting.FlatTree((-1,), (0,), (0,), (0,), (0.0,)), [0]

    def record(n):
        codes = np.stack([draw.integers(0, w, n) for w in widths]).astype(np.uint8)
        return {"n": n, "codes": codes.tobytes(), "packs": boosting.bundled(codes, widths, held).tobytes(), "targets": draw.gamma(2, 9, n).tobytes(),
                "roles": draw.choice([boosting.TRAIN, boosting.VALID], n).astype(np.uint8).tobytes(), "scores": draw.normal(3, 0.1, n).tobytes()}

    def sums(some):
        found = {}
        for one in some:
            for i, part, body in boosting.node_sums(3, widths, held, [(0, p, [])])(one):
                found[part] = found.get(part, 0) + body
        return found

    parts = [record(n) for n in (40, 7, 90)]
    whole = boosting.joined(3)(parts)
    assert whole["n"] == 137
    apart, together = sums(parts), sums([whole])
    assert set(apart) == set(together) == {-1, 0}
    assert all(np.allclose(apart[k], together[k], rtol=1e-12) for k in apart)
