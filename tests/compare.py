"""Run registered queries against their SQL counterparts: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = zip(*[table.column(n).to_pylist() for n in names]) if names else []
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(mine: pa.Table, theirs: pa.Table) -> str | None:
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {mine.column_names} / {theirs.column_names}"
    types = [(n, mine.schema.field(n).type, theirs.schema.field(n).type) for n in mine.column_names
             if mine.schema.field(n).type != theirs.schema.field(n).type]
    if types:
        return f"types {types[:3]}"
    a, b = canonical(mine), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first:\n  {bad[0][0]}\n  {bad[0][1]}" if bad else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from actuspark.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = str(DATA / f"sf{sf}")
    if os.environ.get("PLAIN_SESSION"):  # Spark's own defaults, as a caller without our settings has them
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con, failed = connect(sf_dir), 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            mine = queries[name](spark, sf_dir).toArrow()
            spent = time.time() - start
            if name not in oracles:
                print(f"rows {name:24s} {spent:6.2f}s {mine.num_rows}", flush=True)
                continue
            theirs = con.sql(oracles[name]).to_arrow_table()
            diff = differences(mine, theirs)
        except Exception as error:  # noqa: BLE001
            spent, diff, mine = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}", None
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name:24s} {spent:6.2f}s "
              f"{'' if mine is None else mine.num_rows} {diff or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
