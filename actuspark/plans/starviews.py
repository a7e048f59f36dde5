"""Raw member and claim tables derived from the star-schema test tables.

The same SQL text serves Spark and any other engine; only a few names differ between dialects. The raw tables are
text with ``yyyymmdd`` dates and carry deliberate defects: missing and junk values, impossible dates, repeated
rows, claimants without a member row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actuspark import config as C
from actuspark.session import concurrently, materialize
from actuspark.sources.readers import RawTables, stack_tagged

STAR_CONFIG = C.ClaimsConfig(years=(1999, 2000, 2001), dev_year=1999, oot_year=2000)

JOINED = "@orders LEFT JOIN (@codes) AS codes ON l_orderkey = o_orderkey"
SPARK = {"@EXPLODE": "explode", "@ARRAY": "array", "@ELEMENT": "element_at", "@customer": "{customer}", "@orders": "{orders}",
         "@lineitem": "{lineitem}"}
GENERIC = {"@EXPLODE": "unnest", "@ARRAY": "list_value", "@ELEMENT": "list_extract", "@customer": "customer", "@orders": "orders",
           "@lineitem": "lineitem"}

# Diagnosis codes handed out by part key.
STAR_CODES = ("25000", "4280", "496", "5856", "V4511", "v5631", "1749", "41401", "43491", "2900", "29620",
              "4019", "42731", "40301", "78650", "49", "")


def _render(text: str, dialect: dict[str, str]) -> str:
    for token, name in dialect.items():
        text = text.replace(token, name)
    return text


def _ymd(date: str) -> str:
    return f"CAST(year({date}) * 10000 + month({date}) * 100 + day({date}) AS STRING)"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def member_file_sql(year: int, dialect: dict[str, str] = GENERIC) -> str:
    """The member file of one year: demographics from key arithmetic, amounts from that year's orders."""
    k = "c_custkey"
    paid = lambda status: (f"SUM(CASE WHEN o_orderstatus = '{status}' THEN CAST(o_totalprice AS DECIMAL(18,2)) "  # noqa: E731
                           "ELSE CAST(0 AS DECIMAL(18,2)) END)")
    zero = lambda c: f"COALESCE({c}, CAST(0 AS DECIMAL(18,2)))"
    conditions = ",\n  ".join(
        f"CASE WHEN ({k} * {i + 3} + {year}) % {i + 4} = 0 THEN '1' "
        + (f"WHEN {k} % 401 = 7 THEN NULL " if i == 4 else "") + f"ELSE '2' END AS {c}"
        for i, c in enumerate(C.CHRONIC_COLUMNS))
    coverage = {
        "BENE_HI_CVRAGE_TOT_MONS": f"CASE WHEN {k} % 17 = 0 THEN '0' ELSE '12' END",
        "BENE_SMI_CVRAGE_TOT_MONS": f"CASE WHEN {k} % 34 = 0 THEN '0' ELSE {_text(f'({k} + {year}) % 13')} END",
        "BENE_HMO_CVRAGE_TOT_MONS": _text(f"{k} % 5"),
        "PLAN_CVRG_MOS_NUM": f"CASE WHEN {k} % 83 = 5 THEN NULL ELSE {_text(f'({k} * 3) % 13')} END",
    }
    amounts = [f"{_text(zero('ip'))} AS MEDREIMB_IP",
               f"CASE WHEN {k} % 41 = 0 THEN '-120.50' ELSE {_text(zero('op'))} END AS MEDREIMB_OP",
               f"{_text(zero('car'))} AS MEDREIMB_CAR"]
    amounts += [f"{_text(f'({k} * {m}) % 9{m}7 + {j}')} AS {kind}_{s}"
                for j, kind in enumerate(("BENRES", "PPPYMT")) for m, s in enumerate(C.SETTINGS, start=1)]
    return _render(f"""
SELECT CAST({k} AS STRING) AS {C.ID},
  CASE WHEN {k} % 211 = 3 THEN NULL ELSE CAST(1911 + ({k} * 37) % 64 AS STRING) || '0615' END AS BENE_BIRTH_DT,
  CASE WHEN {k} % 29 = 1 AND {year} >= 2000 THEN '2000' || lpad(CAST(1 + {k} % 12 AS STRING), 2, '0') || '15'
       WHEN {k} % 31 = 0 THEN '' END AS BENE_DEATH_DT,
  CASE WHEN {k} % 2 = 0 THEN '1' ELSE '2' END AS BENE_SEX_IDENT_CD,
  CASE {k} % 7 WHEN 4 THEN '2' WHEN 5 THEN '3' WHEN 6 THEN '5' ELSE '1' END AS BENE_RACE_CD,
  CASE WHEN {k} % 13 = 0 THEN 'Y' ELSE '0' END AS BENE_ESRD_IND,
  CAST(c_nationkey AS STRING) AS SP_STATE_CODE,
  {", ".join(f"{v} AS {c}" for c, v in coverage.items())},
  {conditions},
  {", ".join(amounts)}
FROM @customer LEFT JOIN (
  SELECT o_custkey, {paid('F')} AS ip, {paid('O')} AS op, {paid('P')} AS car
  FROM @orders WHERE o_orderdate >= TIMESTAMP '{year}-01-01 00:00:00' AND o_orderdate < TIMESTAMP '{year + 1}-01-01 00:00:00'
  GROUP BY o_custkey) AS amt ON o_custkey = {k}
WHERE {k} % 19 <> {year % 19}""", dialect)


def _codes_sql() -> str:
    """Per order: supplier and code number by line number. Numbers keep the aggregation a hash aggregation."""
    slots = ", ".join(f"MAX(CASE WHEN l_linenumber = {i} THEN l_partkey % {len(STAR_CODES)} END) AS c{i}"
                      for i in range(1, 8))
    return f"SELECT l_orderkey, MIN(l_suppkey) AS supplier, {slots} FROM @lineitem GROUP BY l_orderkey"


def _code(slot: int) -> str:
    codes = ", ".join(f"'{c}'" for c in STAR_CODES)
    return f"CASE WHEN c{slot} IS NOT NULL THEN @ELEMENT(@ARRAY({codes}), CAST(c{slot} + 1 AS INT)) END"


def _joined_sql() -> str:
    return JOINED.replace("@codes", _codes_sql())


def coded_orders_sql(dialect: dict[str, str] = GENERIC) -> str:
    """The orders that are claims of either kind, with supplier and codes of their lines."""
    columns = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, supplier"
    slots = ", ".join(f"CAST(c{i} AS INT) AS c{i}" for i in range(1, 8))
    return _render(f"SELECT {columns}, {slots} FROM {_joined_sql()} WHERE o_orderstatus IN ('F', 'O')", dialect)


def claims_sql(kind: str, dialect: dict[str, str] = GENERIC, source: str | None = None) -> str:
    """Inpatient claims from orders of status F, outpatient claims from status O; codes from the order lines.

    ``source`` may name a table that holds the rows of :func:`coded_orders_sql`.
    """
    k = "o_orderkey"
    start = _ymd("o_orderdate")
    thru = _ymd(f"(CAST(o_orderdate AS DATE) + CAST(1 + {k} % 9 AS INT))")
    dx = ", ".join([f"{_code(i)} AS {c}" if i < 8 else f"CAST(NULL AS STRING) AS {c}"
                    for i, c in enumerate(C.DX_COLUMNS, start=1)])
    if kind == "inpatient":
        status, extra = "F", (
            f"CASE WHEN {k} % 10 = 0 THEN '' WHEN {k} % 7 = 0 THEN NULL ELSE {start} END AS CLM_ADMSN_DT, "
            f"{thru} AS NCH_BENE_DSCHRG_DT, "
            f"CASE WHEN {k} % 11 = 0 THEN '' WHEN {k} % 89 = 0 THEN '3x' ELSE {_text(f'{k} % 9 + 1')} END "
            f"AS CLM_UTLZTN_DAY_CNT, {_text(f'{k} % 700')} AS CLM_DRG_CD")
    else:
        status, extra = "O", ", ".join([
            f"CASE WHEN o_orderpriority = '1-URGENT' AND {k} % 3 = {i} THEN {_text(f'99280 + {k} % 7')} "
            f"WHEN {k} % 4 = {i} THEN NULL ELSE '80053' END AS {c}"
            for i, c in enumerate(C.HCPCS_COLUMNS)])
    return _render(f"""
SELECT CASE WHEN {k} % 251 = 0 THEN 'X' ELSE '' END || CAST(o_custkey AS STRING) AS {C.ID},
  CAST({k} AS STRING) AS CLM_ID,
  @EXPLODE(CASE WHEN {k} % 50 = 0 THEN @ARRAY('1', '1') WHEN {k} % 60 = 0 THEN @ARRAY('1', '2')
                ELSE @ARRAY('1') END) AS SEGMENT,
  CASE WHEN {k} % 307 = 0 THEN '' WHEN {k} % 311 = 0 THEN NULL ELSE {start} END AS CLM_FROM_DT,
  CASE WHEN {k} % 101 = 0 THEN CAST(year(o_orderdate) AS STRING) || '0431'
       WHEN {k} % 103 = 0 THEN CAST(year(o_orderdate) AS STRING) || '1301' ELSE {thru} END AS CLM_THRU_DT,
  CASE WHEN {k} % 97 = 0 THEN NULL ELSE CAST(supplier AS STRING) END AS PRVDR_NUM,
  CASE WHEN {k} % 331 = 0 THEN '-50.00' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS CLM_PMT_AMT,
  '0.00' AS NCH_PRMRY_PYR_CLM_PD_AMT, {dx}, {extra}
FROM {source or _joined_sql()}
WHERE o_orderstatus = '{status}'""", dialect)


# The columns read from the test tables. A given schema spares one footer-reading job per table.
TABLES = {
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate timestamp",
    "events": "ts timestamp, event_type string, value double",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.schema(TABLES[n]).parquet(f"{sf_dir}/{n}.parquet") for n in names}


def star_member_files(spark: SparkSession, sf_dir: str, cfg: C.ClaimsConfig = STAR_CONFIG) -> dict[int, DataFrame]:
    t = tables(spark, sf_dir, "customer", "orders")
    return {y: spark.sql(member_file_sql(y, SPARK), **t) for y in cfg.years}


def star_members(spark: SparkSession, sf_dir: str, cfg: C.ClaimsConfig = STAR_CONFIG) -> DataFrame:
    return stack_tagged(star_member_files(spark, sf_dir, cfg))


def star_claims(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return spark.sql(claims_sql(kind, SPARK), **tables(spark, sf_dir, "orders", "lineitem"))


def star_raw(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(star_members(spark, sf_dir), star_claims(spark, sf_dir, "inpatient"),
                     star_claims(spark, sf_dir, "outpatient"))


def stored_claims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """:func:`star_claims` of both kinds over one stored table: the order lines are read, counted and joined once."""
    coded = materialize(spark.sql(coded_orders_sql(SPARK), **tables(spark, sf_dir, "orders", "lineitem")), "coded")
    return {kind: spark.sql(claims_sql(kind, SPARK, "{coded}"), coded=coded) for kind in ("inpatient", "outpatient")}


def stored_star_raw(spark: SparkSession, sf_dir: str) -> RawTables:
    """:func:`star_raw` for work that needs both claim tables whole."""
    return RawTables(star_members(spark, sf_dir), **stored_claims(spark, sf_dir))


def staged_raw(spark: SparkSession, sf_dir: str) -> RawTables:
    """:func:`star_raw` with the claim tables stored, for work that reads them several times."""
    raw = stored_star_raw(spark, sf_dir)
    inpatient, outpatient = concurrently([
        lambda: materialize(raw.inpatient, "stg_ip"), lambda: materialize(raw.outpatient, "stg_op")])
    return RawTables(raw.members, inpatient, outpatient)


def generic_views(cfg: C.ClaimsConfig = STAR_CONFIG) -> dict[str, str]:
    """The same three tables as SQL for another engine: name to query text."""
    members = "\nUNION ALL\n".join(
        f"SELECT *, {y} AS FILE_YEAR FROM ({member_file_sql(y)}) AS m{y}" for y in cfg.years)
    return {"stg_bene": members, "stg_ip": claims_sql("inpatient"), "stg_op": claims_sql("outpatient")}
