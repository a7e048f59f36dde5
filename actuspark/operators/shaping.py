"""Grouping, joining and reshaping operators, parameterised by column names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actuspark.config import CodeGroup
from actuspark.functions.columns import filled, flag, hash_number, hash_share


def distinct_counts(df: DataFrame, keys: Sequence[str], counts: Mapping[str, Column],
                    max_error: float | None = None) -> DataFrame:
    """Distinct non-NULL values per key, several at once; ``max_error`` switches to sketches of that relative error."""
    count = F.countDistinct if max_error is None else lambda c: F.approx_count_distinct(c, max_error)
    return df.groupBy(*keys).agg(*[count(c).alias(out) for out, c in counts.items()])


def unpivot_codes(df: DataFrame, ids: Sequence[str], slots: Sequence[str], out: str = "code") -> DataFrame:
    """One row per filled code slot, from a single scan."""
    codes = F.filter(F.array(*[F.col(s) for s in slots]), filled)
    return df.select(*ids, F.explode(codes).alias(out))


def code_condition(code: str, group: CodeGroup, upper: str | None = None) -> Column:
    """Whether a code belongs to a group: prefixes ignore ASCII case, codes and heads do not.

    ``upper`` may name a column that already holds the upper-case code.
    """
    tests = [f"startswith({upper or f'upper({code})'}, '{p.upper()}')" for p in group.prefixes]
    if group.codes:
        tests.append(f"{code} IN ({', '.join(repr(c) for c in group.codes)})")
    if group.heads:
        tests.append(f"substring({code}, 1, 3) BETWEEN '{group.heads[0]}' AND '{group.heads[1]}'")
    return F.expr(" OR ".join(tests))


def code_group_flags(df: DataFrame, keys: Sequence[str], code: str, groups: Sequence[CodeGroup],
                     distinct: str | None = None) -> DataFrame:
    """Per key: one 0/1 flag per code group. ``distinct`` also counts rows, for input distinct on (keys, code)."""
    rows = df.select(*keys, code, F.upper(code).alias("_upper"))
    aggs = [F.max(flag(code_condition(code, g, "_upper"))).alias(g.name) for g in groups]
    if distinct:
        aggs.insert(0, F.count(code).alias(distinct))
    return rows.groupBy(*keys).agg(*aggs)


def next_period(df: DataFrame, key: str, period: str, carried: Mapping[str, str]) -> DataFrame:
    """Left join of every row to the same key one period later: the shifted key keeps it a plain equi-join."""
    later = df.select(
        F.col(key), (F.col(period) - 1).alias(period), *[F.col(c).alias(out) for out, c in carried.items()])
    return df.join(later, [key, period], "left")


def star_join(base: DataFrame, sides: Iterable[DataFrame], keys: Sequence[str], zero_fill: bool = True) -> DataFrame:
    """Left joins on shared keys. Columns that come from the sides read 0 where there is no match."""
    sides = list(sides)
    joined = reduce(lambda left, right: left.join(right, list(keys), "left"), sides, base)
    if not zero_fill:
        return joined
    added = {c for side in sides for c in side.columns if c not in keys}
    return joined.selectExpr([f"coalesce(`{c}`, 0) AS `{c}`" if c in added else f"`{c}`" for c in joined.columns])


def waterfall(df: DataFrame, period: str, flags: Sequence[str], rules: Sequence[str],
              out_period: str = "feature_year") -> DataFrame:
    """Rows left after each cumulative rule, long form, from one aggregation. NULL flags drop out of the sum."""
    if len(rules) != len(flags) + 1:
        raise ValueError("need one rule label more than flags (the first counts all rows)")
    steps = [F.count(F.lit(1)).alias("_s1")]
    product = None
    for i, name in enumerate(flags, start=2):
        product = F.col(name) if product is None else product * F.col(name)
        steps.append(F.sum(product.cast("bigint")).alias(f"_s{i}"))
    wide = df.groupBy(period).agg(*steps)
    items = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(rule).alias("rule"), F.col(f"_s{i}").alias("n"))
                      for i, rule in enumerate(rules, start=1)])
    return wide.select(F.col(period).alias(out_period), F.explode(items).alias("_s")).select(
        out_period, "_s.step", "_s.rule", "_s.n")


def pivot_periods(df: DataFrame, keys: Sequence[str], period: str, value: str, periods: Sequence[int]) -> DataFrame:
    """Long to wide over a known list of periods."""
    return df.groupBy(*keys).pivot(period, list(periods)).agg(F.sum(value))


def repeated_keys(df: DataFrame, keys: Sequence[str], out: str = "n_duplicates") -> DataFrame:
    """How many key values occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum((F.col("_n") > 1).cast("bigint")), F.lit(0)).alias(out))


def shares(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Share of rows meeting each condition (unknown ignored): one row, one scan."""
    return df.agg(*[F.avg(flag(c)).alias(out) for out, c in conditions.items()])


def grouped_sets(df: DataFrame, dimensions: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """The same aggregates by each dimension in turn: ``(dimension, level, ...)`` from one scan."""
    if any(d not in df.columns for d in dimensions):
        raise ValueError("unknown dimension")
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level"))
                                for d in dimensions]))
    return df.select("*", pairs.alias("_d")).groupBy(
        F.col("_d.dimension").alias("dimension"), F.col("_d.level").alias("level")).agg(*aggs)


def columns_starting(columns: Iterable[str], prefixes: Sequence[str], exact: Sequence[str] = ()) -> list[str]:
    """Names that start with one of the prefixes or are listed."""
    return [c for c in columns if c.startswith(tuple(prefixes)) or c in exact]


def hash_split(df: DataFrame, keys: Sequence[str], seed: int, test_share: float, out: str = "is_test") -> DataFrame:
    """Repeatable random split: each key falls on the test side with the given probability."""
    return df.withColumn(out, (hash_share(keys, seed) < test_share).cast("int"))


def hash_sample(df: DataFrame, keys: Sequence[str], seed: int, size: int) -> DataFrame:
    """Repeatable random sample without replacement of at most ``size`` rows."""
    picked = df.withColumn("_h", hash_number(keys, seed))
    return picked.orderBy("_h", *keys).limit(size).drop("_h")
