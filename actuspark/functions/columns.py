"""Column expressions: lenient casts, dates, bands, code tests and keyed hashing. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

INTEGER_PREFIX = r"^\s*([+-]?\d+)"
REAL_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    return f"`{name}`"


def _prefix_cast(c: str, pattern: str, kind: str, junk: str) -> Column:
    """The pattern is matched only where a plain cast does not give the same: text that is a number throughout needs none."""
    if junk not in ("zero", "null"):
        raise ValueError("junk must be 'zero' or 'null'")
    default = "0" if junk == "zero" else "NULL"
    # first a digit, so no names of infinity; casts also read hexadecimal reals, which have an x
    plain = f"{c} >= '0' AND {c} < ':'" + (f" AND instr({c}, 'x') = 0 AND instr({c}, 'X') = 0" if kind == "double" else "")
    return F.expr(f"CASE WHEN {c} IS NOT NULL THEN coalesce(CASE WHEN {plain} THEN try_cast({c} AS {kind}) END, "
                  f"try_cast(regexp_extract({c}, r'{pattern}', 1) AS {kind}), CAST({default} AS {kind})) END")


def lenient_int(c: str, junk: str = "zero") -> Column:
    """Leading integer of a text column. Text without one gives 0 (or NULL with ``junk='null'``); NULL stays NULL."""
    return _prefix_cast(quoted(c), INTEGER_PREFIX, "bigint", junk)


def lenient_real(c: str, junk: str = "zero") -> Column:
    """Leading decimal number of a text column, under the same rules as :func:`lenient_int`."""
    return _prefix_cast(quoted(c), REAL_PREFIX, "double", junk)


def number_or_zero(c: ColumnOrName) -> Column:
    """Coerce to double; unparsable, NULL and NaN become 0."""
    return F.coalesce(F.nanvl(as_col(c).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def floored(c: ColumnOrName) -> Column:
    """:func:`number_or_zero`, with negatives raised to 0."""
    return F.greatest(number_or_zero(c), F.lit(0.0))


def money(c: ColumnOrName) -> Column:
    """Exact decimal view of an amount, so that sums do not depend on the order of addition."""
    return as_col(c).cast("decimal(24,4)")


def money_sum(c: ColumnOrName) -> Column:
    return F.sum(money(c)).cast("double")


def filled(c: ColumnOrName) -> Column:
    """True where the text is neither NULL nor empty."""
    if isinstance(c, str):
        return F.expr(f"({c} IS NOT NULL AND {c} <> '')")
    return c.isNotNull() & (c != "")


def blank(c: str) -> Column:
    """True where the text is NULL or empty."""
    return F.expr(f"({c} IS NULL OR {c} = '')")


def or_else(c: str, default: str) -> str:
    """SQL text: ``c`` unless NULL or empty, else ``default``."""
    return f"coalesce(nullif({c}, ''), {default})"


def flag(condition: Column) -> Column:
    """0/1 form of a condition; unknown stays NULL."""
    return condition.cast("int")


def row_sum(columns: Iterable[ColumnOrName]) -> Column:
    """Sum across columns; NULL when any of them is NULL."""
    return reduce(add, [as_col(c) for c in columns])


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def year_of(c: str) -> Column:
    """Year prefix of a ``yyyymmdd`` text; NULL stays NULL."""
    return _prefix_cast(f"substring({quoted(c)}, 1, 4)", INTEGER_PREFIX, "bigint", "zero")


def calendar_day(c: str) -> Column:
    """``yyyymmdd`` text (a column or SQL expression) to a date.

    Days 1-31 are accepted in every month and roll over; anything else gives NULL.
    """
    part = lambda start, n: f"try_cast(substring({c}, {start}, {n}) AS int)"
    return F.expr(
        f"CASE WHEN {c} RLIKE r'^\\d{{8}}' AND {part(5, 2)} BETWEEN 1 AND 12 AND {part(7, 2)} BETWEEN 1 AND 31 "
        f"THEN date_add(make_date({part(1, 4)}, {part(5, 2)}, 1), {part(7, 2)} - 1) END")


def larger(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Two-argument maximum that is NULL when either side is NULL."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def band(c: str, edges: Sequence[float], labels: Sequence[str], outside: str = "nan") -> Column:
    """Label of the interval ``(edge, next edge]`` that holds the value; ``outside`` elsewhere and for NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    steps = " ".join(f"WHEN {c} <= {e} THEN '{label}'" for e, label in zip(edges[1:], labels))
    beyond = f"{c} IS NULL OR isnan(CAST({c} AS double)) OR {c} <= {edges[0]} OR {c} > {edges[-1]}"
    return F.expr(f"CASE WHEN {beyond} THEN '{outside}' {steps} END")


def labelled(c: ColumnOrName, labels: Mapping[object, str], default: str | Column) -> Column:
    """Fixed lookup of a code; ``default`` for codes not listed."""
    c = as_col(c)
    items = list(labels.items())
    chain = F.when(c == items[0][0], F.lit(items[0][1]))
    for code, label in items[1:]:
        chain = chain.when(c == code, F.lit(label))
    return chain.otherwise(default)


def either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def hash_number(keys: Sequence[ColumnOrName] | ColumnOrName, salt: object) -> Column:
    """Uniform integer in [0, 2^32) keyed by the columns and a salt; the same on every engine with md5."""
    keys = [keys] if isinstance(keys, (str, Column)) else list(keys)
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    text = F.concat_ws("|", *[as_col(k).cast("string") for k in keys], salt.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_share(keys: Sequence[ColumnOrName] | ColumnOrName, salt: object) -> Column:
    """:func:`hash_number` scaled to [0, 1)."""
    return hash_number(keys, salt) / F.lit(float(2**32))


def divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Ratio that is NULL on a zero denominator."""
    return F.try_divide(as_col(a), as_col(b))


def correlation(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Pearson correlation aggregate; NULL (not an error) when a side is constant."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def finite(c: ColumnOrName) -> Column:
    """NULL in place of infinities."""
    c = as_col(c)
    return F.when(F.abs(c) != F.lit(float("inf")), c)
