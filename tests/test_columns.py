"""Scalar rules on hand-made edge values."""

import hashlib

from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.functions import columns as X
from actuspark.operators.shaping import code_condition


def values(spark, items, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r["out"] for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_lenient_int_modes(spark):
    texts = ["", None, "12x", "abc", " 7", "-3", "+4", "12.9"]
    assert values(spark, texts, "string", X.lenient_int("x")) == [0, None, 12, 0, 7, -3, 4, 12]
    assert values(spark, texts, "string", X.lenient_int("x", "null")) == [None, None, 12, None, 7, -3, 4, 12]


def test_lenient_real(spark):
    texts = ["", None, "12.5x", "abc", " .5", "-3", "1e3", "7."]
    assert values(spark, texts, "string", X.lenient_real("x")) == [0.0, None, 12.5, 0.0, 0.5, -3.0, 1000.0, 7.0]


def test_plain_casts_give_what_the_pattern_gives(spark):
    texts = ["12", "12 ", "0x1F", "0X1p3", "1d", "2.5f", "12L", "1e400", "Infinity", "-inf", "NaN", "\x0112", "1.", "1e", "12 34", "007",
             "99999999999999999999"]
    inf = float("inf")
    assert values(spark, texts, "string", X.lenient_real("x")) == [
        12.0, 12.0, 0.0, 0.0, 1.0, 2.5, 12.0, inf, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 12.0, 7.0, 1e20]
    assert values(spark, texts, "string", X.lenient_int("x", "null")) == [
        12, 12, 0, 0, 1, 2, 12, 1, None, None, None, None, 1, 1, 12, 7, None]


def test_calendar_day_rolls_over_and_rejects(spark):
    texts = ["20090431", "20090230", "20090432", "20091301", "20090400", "", None, "20080229", "2009"]
    got = [None if d is None else d.isoformat() for d in values(spark, texts, "string", X.calendar_day("x"))]
    assert got == ["2009-05-01", "2009-03-02", None, None, None, None, None, "2008-02-29", None]


def test_or_else_and_year(spark):
    df = spark.createDataFrame([("", "20090101"), (None, "20090102"), ("20090103", "x")], "a string, b string")
    got = [r[0].day for r in df.select(X.calendar_day(X.or_else("a", "b"))).collect()]
    assert got == [1, 2, 3]
    assert values(spark, ["20091231", None, ""], "string", X.year_of("x")) == [2009, None, 0]


def test_larger_is_null_when_a_side_is_null(spark):
    df = spark.createDataFrame([(3, None), (None, 3), (2, 5), (5, 2)], "a int, b int")
    assert [r[0] for r in df.select(X.larger("a", "b")).collect()] == [None, None, 5, 5]


def test_row_sum_is_null_when_any_is_null(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 0, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(X.row_sum(["a", "b", "c"])).collect()] == [None, 2]


def test_bands_are_closed_on_the_right(spark):
    ages = [0.0, 64.0, 65.0, 84.0, 85.0, 200.0, 201.0, None]
    assert values(spark, ages, "double", X.band("x", *C.AGE_BANDS)) == [
        "nan", "<65", "65-69", "80-84", "85+", "85+", "nan", "nan"]
    amounts = [-1.0, 0.0, 0.5, 1000.0, 1e12, 2e12]
    assert values(spark, amounts, "double", X.band("x", *C.PRIOR_COST_BANDS)) == [
        "nan", "$0", "$1-1k", "$1-1k", "$20k+", "nan"]


def test_labels(spark):
    assert values(spark, [1, 5, 4, None], "int", X.labelled("x", C.RACE_LABELS, "Unknown")) == [
        "White", "Hispanic", "Unknown", "Unknown"]


def test_hash_number_matches_md5(spark):
    got = values(spark, ["a", "b"], "string", X.hash_number("x", 7))
    assert got == [int(hashlib.md5(f"{t}|7".encode()).hexdigest()[:8], 16) for t in "ab"]


def test_number_or_zero(spark):
    assert values(spark, ["1.5", "x", None, "NaN"], "string", X.number_or_zero("x")) == [1.5, 0.0, 0.0, 0.0]
    assert values(spark, [-2.0, 3.0], "double", X.floored("x")) == [0.0, 3.0]


def test_code_groups(spark):
    codes = ["250", "25000", "5856", "V4511", "v451", "49", "490", "2089", "209", "1400", "40201", "", None]
    groups = {g.name: g for g in C.CODE_GROUPS}

    def hit(name):
        got = values(spark, codes, "string", code_condition("x", groups[name]).cast("int"))
        return {c for c, v in zip(codes, got) if v == 1}

    assert hit("dx_diabetes") == {"250", "25000"}
    assert hit("dx_esrd") == {"5856", "V4511", "v451"}
    assert hit("dx_copd") == {"490"}
    assert hit("dx_cancer") == {"2089", "1400"}
    assert hit("dx_chf") == {"40201"}
    assert hit("dx_hypertension") == {"40201"}


def test_finite_and_divide(spark):
    assert values(spark, [1.0, float("inf"), float("-inf")], "double", X.finite("x")) == [1.0, None, None]
    assert values(spark, [1.0], "double", X.divide("x", F.lit(0.0))) == [None]
