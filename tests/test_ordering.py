"""Global ranks, running totals, bins, quantiles and previous-row operators against plain pandas / numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from actuspark.operators import ranking, sequences

rng = np.random.default_rng(5)


@pytest.fixture(scope="module")
def frame():
    n = 3000
    return pd.DataFrame({
        "id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "v": np.where(rng.random(n) < 0.4, 1.0, rng.gamma(2, 50, n).round(2))})


def test_global_rank_with_hot_tie(spark, frame):
    got = ranking.global_rank(spark.createDataFrame(frame), [F.col("v"), F.col("id")]).toPandas()
    want = frame.sort_values(["v", "id"]).reset_index(drop=True)
    assert list(got.sort_values("rank")["id"]) == list(want["id"])
    assert got["rank"].max() == len(frame) and got["rank"].is_unique


def test_global_rank_by_group(spark, frame):
    got = ranking.global_rank(spark.createDataFrame(frame), [F.col("v").desc(), F.col("id")], group=["g"]).toPandas()
    want = frame.sort_values(["v", "id"], ascending=[False, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="id")
    assert (merged["rank_x"] == merged["rank_y"]).all()


def test_running_totals_by_group(spark, frame):
    per = frame.groupby(["g", "v"]).size().reset_index(name="c")
    got = ranking.running_totals(spark.createDataFrame(per), [F.col("v")], {"upto": "c"}, ["g"]).toPandas()
    per["upto"] = per.sort_values("v").groupby("g")["c"].cumsum()
    merged = got.merge(per, on=["g", "v"])
    assert len(merged) == len(per) and (merged["upto_x"] == merged["upto_y"]).all()


@pytest.mark.parametrize("n", [1, 2, 10, 12, 93, 1000])
def test_bin_sizes_follow_the_linear_cut_rule(spark, n):
    df = spark.range(n).withColumn("s", F.lit(1.0))
    got = ranking.equal_frequency_bins(df, [F.col("s"), F.col("id")], 10, "bin").toPandas()
    ranks = np.arange(1, n + 1)
    want = pd.qcut(ranks, 10, labels=False) + 1 if n > 1 else np.array([1])
    assert list(got.sort_values("id")["bin"]) == list(want)


def test_published_decile_sizes(spark):
    df = spark.range(106_186).selectExpr("id + 1 AS rank", "106186L AS n")
    sizes = df.select(ranking.bin_of_rank("rank", "n").alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in sizes][:4] == [10619, 10619, 10618, 10619]


@pytest.mark.parametrize("single_pass_rows", [10**9, 0])
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles_both_ways(spark, frame, single_pass_rows, accuracy):
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 0.999, 1.0]
    got = ranking.exact_quantiles(spark.createDataFrame(frame), "v", probs, ["g"], accuracy=accuracy,
                                  single_pass_rows=single_pass_rows).toPandas()
    for g, part in frame.groupby("g"):
        have = got[got.g == g].sort_values("prob")["quantile"].to_numpy()
        assert np.allclose(have, np.quantile(part.v, probs), rtol=0, atol=1e-9)


def test_quantile_of_the_whole_table(spark, frame):
    df = spark.createDataFrame(frame)
    assert ranking.quantile_value(df, "v", 0.9, single_pass_rows=0) == pytest.approx(np.quantile(frame.v, 0.9))


def stays_frame(spark):
    d = lambda s: None if s is None else dt.date.fromisoformat(s)
    rows = [
        ("gap30", "2008-01-01", "2008-01-05"), ("gap30", "2008-02-04", "2008-02-06"),
        ("gap31", "2008-01-01", "2008-01-05"), ("gap31", "2008-02-05", "2008-02-06"),
        ("sameday", "2008-01-01", "2008-01-05"), ("sameday", "2008-01-05", "2008-01-09"),
        ("overlap", "2008-01-01", "2008-01-20"), ("overlap", "2008-01-10", "2008-01-12"), ("overlap", "2008-01-30", "2008-01-31"),
        ("newyear", "2008-12-20", "2008-12-28"), ("newyear", "2009-01-03", "2009-01-04"),
        ("noadmit", None, "2008-01-05"), ("noadmit", "2008-01-10", "2008-01-11"),
        ("single", "2008-01-01", "2008-01-02"),
    ]
    return spark.createDataFrame([(m, i, d(a), d(b)) for i, (m, a, b) in enumerate(rows)],
                                 "member string, claim int, admit date, discharge date")


@pytest.mark.parametrize("hot", [10**6, 1])
def test_follow_ups_edges(spark, hot):
    got = sequences.follow_ups(stays_frame(spark), "member", "admit", "discharge", ["claim"], hot_key_rows=hot)
    found = sorted((r["member"], r["gap_days"]) for r in got.collect())
    # the overlap member's last stay is measured from the previous row, not from the latest discharge
    assert found == [("gap30", 30), ("newyear", 6), ("noadmit", 5), ("overlap", 18), ("sameday", 0)]


def test_hot_keys_use_blocks_and_agree(spark):
    n = 4000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.5, "hot", rng.choice([f"k{i}" for i in range(400)], n)),
                        "o": rng.integers(0, 500, n), "id": np.arange(n), "v": rng.integers(0, 99, n)})
    df = spark.createDataFrame(pdf)
    order = [F.col("o"), F.col("id")]
    plain = sequences.previous_values(df, "k", order, {"prev": "v"}).toPandas()
    split = sequences.previous_values(df, "k", order, {"prev": "v"}, hot_key_rows=50).toPandas()
    assert sequences.hot_keys(df, "k", 50).count() == 1
    a, b = (x.sort_values("id").reset_index(drop=True)["prev"] for x in (plain, split))
    assert len(split) == n and ((a == b) | (a.isna() & b.isna())).all()


def test_period_change(spark):
    df = spark.createDataFrame([(2008, 100.0), (2009, 110.0), (2010, 55.0)], "y int, v double")
    got = [r["change"] for r in sequences.period_change(df, "y", "v").orderBy("y").collect()]
    assert got[0] is None and got[1] == pytest.approx(0.1) and got[2] == pytest.approx(-0.5)


def test_small_table_keeps_large_tables_distributed(spark):
    from actuspark.session import small_table

    assert small_table(spark.range(50), 10).count() == 50
    pdf = pd.DataFrame({"id": range(300), "g": [i % 40 for i in range(300)]})
    per = spark.createDataFrame(pdf).groupBy("g").agg(F.count("*").alias("n"))
    joined = ranking.attach(spark.createDataFrame(pdf), per, ["g"])
    assert joined.count() == 300 and joined.filter("n is null").count() == 0
