"""Data-quality suite: eighteen checks over the staged tables, one status rule for all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.functions.columns import blank, filled, flag, lenient_int, lenient_real, year_of
from actuspark.operators.sequences import period_change
from actuspark.operators.shaping import repeated_keys, shares
from actuspark.session import concurrently, materialize
from actuspark.sources.readers import RawTables


@dataclass(frozen=True)
class Check:
    check_id: str
    category: str
    description: str
    threshold: float
    rule: str = "max"


def suite(years: tuple[int, ...]) -> list[Check]:
    """Thresholds are fixed values; ids, categories and rules likewise."""
    span = f"{years[0]}-{years[-1]}"
    volume = [Check(f"DQ-{i:02d}", "Volume", f"Member rows, file year {y}", 0.0, "info")
              for i, y in enumerate(years, start=1)]
    return volume + [
        Check("DQ-04", "Uniqueness", "Repeated member-year keys", 0.0),
        Check("DQ-05", "Uniqueness", "Repeated inpatient keys (claim, segment)", 0.0),
        Check("DQ-06", "Uniqueness", "Repeated outpatient keys (claim, segment)", 0.0),
        Check("DQ-07", "Completeness", "Member rows without birth date", 0.0),
        Check("DQ-08", "Validity", "Member rows with age outside 18-110", 0.001),
        Check("DQ-09", "Validity", "Member rows with a negative reimbursement", 0.001),
        Check("DQ-10", "Validity", "Inpatient rows with a negative payment", 0.001),
        Check("DQ-11", "Validity", "Inpatient rows ending before they start", 0.001),
        Check("DQ-12", "Completeness", "Outpatient rows without service date", 0.01),
        Check("DQ-13", "Validity", f"Inpatient rows dated outside {span}", 0.01),
        Check("DQ-14", "Completeness", "Outpatient rows without principal diagnosis", 0.02),
        Check("DQ-15", "Integrity", "Inpatient claimants absent from the member files", 0.001),
        Check("DQ-16", "Consistency", "Decedents' inpatient rows dated after death", 0.01),
        Check("DQ-17", "Reconciliation", "Largest gap of inpatient claims to member totals, any year", 0.05),
        Check("DQ-18", "Completeness", "Largest yearly move of mean paid per member", 0.05),
    ]


def status(value: Column, threshold: Column, rule: Column) -> Column:
    """PASS / WARN / FAIL against a maximum (WARN up to 5x) or minimum (WARN down to 0.8x); INFO otherwise."""
    graded = lambda ok, near: F.when(ok, "PASS").when(near, "WARN").otherwise("FAIL")
    return (
        F.when(rule == "max", graded(value <= threshold, value <= threshold * 5))
        .when(rule == "min", graded(value >= threshold, value >= threshold * 0.8))
        .otherwise("INFO"))


def store_and_check(raw: RawTables, years: tuple[int, ...]) -> DataFrame:
    """The suite over tables that are not stored yet: each is computed once."""
    tables, seen = stored(raw, years)
    return run_suite(tables, years, seen=seen)


def graded(observations: DataFrame, checks: list[Check]) -> DataFrame:
    """Checks with observed value and status. The status is decided before the value is rounded."""
    spark = observations.sparkSession
    rules = spark.createDataFrame(
        [(c.check_id, c.category, c.description, float(c.threshold), c.rule) for c in checks],
        "check_id string, category string, description string, threshold double, rule string")
    joined = rules.join(observations, "check_id", "left").withColumn("_v", F.coalesce("observed", F.lit(0.0)))
    return joined.select(
        "check_id", "category", "description", F.round("_v", 4).alias("observed"), "threshold", "rule",
        status(F.col("_v"), F.col("threshold"), F.col("rule")).alias("status"))


def volumes(members: DataFrame) -> DataFrame:
    return members.groupBy(F.col("FILE_YEAR").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"))


def duplicates(raw: RawTables) -> DataFrame:
    """One row with the number of repeated keys of each staged table."""
    parts = [
        ("DQ-04", raw.members, [C.ID, "FILE_YEAR"]), ("DQ-05", raw.inpatient, ["CLM_ID", "SEGMENT"]),
        ("DQ-06", raw.outpatient, ["CLM_ID", "SEGMENT"])]
    out = None
    for check, df, keys in parts:
        one = repeated_keys(df, keys).select(F.lit(check).alias("check_id"), "n_duplicates")
        out = one if out is None else out.unionByName(one)
    return out


def member_conditions() -> dict[str, Column]:
    """DQ-07 to DQ-09."""
    age = F.col("FILE_YEAR") - year_of("BENE_BIRTH_DT")
    low = [lenient_real(f"MEDREIMB_{s}") < 0 for s in C.SETTINGS]
    return {"DQ-07": blank("BENE_BIRTH_DT"), "DQ-08": ~age.between(18, 110), "DQ-09": low[0] | low[1] | low[2]}


def inpatient_conditions(years: tuple[int, ...]) -> dict[str, Column]:
    """DQ-10, DQ-11 and DQ-13."""
    dated = filled("CLM_FROM_DT")
    early = lenient_int("CLM_THRU_DT") < lenient_int("CLM_FROM_DT")
    outside = ~F.substring("CLM_FROM_DT", 1, 4).isin(*[str(y) for y in years])
    return {"DQ-10": lenient_real("CLM_PMT_AMT") < 0, "DQ-11": F.when(dated, early), "DQ-13": F.when(dated, outside)}


def outpatient_conditions() -> dict[str, Column]:
    """DQ-12 and DQ-14."""
    return {"DQ-12": blank("CLM_FROM_DT"), "DQ-14": blank(C.DX_COLUMNS[0])}


def stored(raw: RawTables, years: tuple[int, ...]) -> tuple[RawTables, DataFrame]:
    """The three tables stored, and (check_id, observed) of all checks that look at single rows: DQ-01 to DQ-03, DQ-07 to DQ-14.

    These are counted while the tables are written, so they cost no scan of their own.
    """
    volume = {f"DQ-{i:02d}": F.count(F.when(F.col("FILE_YEAR") == y, 1)).cast("double") for i, y in enumerate(years, start=1)}
    share = lambda conditions: {check: F.avg(flag(c)) for check, c in conditions.items()}
    plan = [("stg_bene", raw.members, volume | share(member_conditions())), ("stg_ip", raw.inpatient, share(inpatient_conditions(years))),
            ("stg_op", raw.outpatient, share(outpatient_conditions()))]

    def write(label: str, df: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, dict[str, float | None]]:
        seen = Observation(label)
        table = materialize(df.observe(seen, *[c.alias(check) for check, c in values.items()]), label)
        return table, seen.get

    done = concurrently([lambda one=one: write(*one) for one in plan])
    rows = [(check, value) for _, values in done for check, value in values.items()]
    return RawTables(*[table for table, _ in done]), raw.members.sparkSession.createDataFrame(rows, "check_id string, observed double")


def long_checks(wide: DataFrame) -> DataFrame:
    """One-row wide table of check values to (check_id, observed)."""
    items = F.array(*[F.struct(F.lit(c).alias("check_id"), F.col(f"`{c}`").cast("double").alias("observed"))
                      for c in wide.columns])
    return wide.select(F.explode(items).alias("_x")).select("_x.*")


def share_checks(raw: RawTables, years: tuple[int, ...]) -> DataFrame:
    """DQ-07 to DQ-14 as (check_id, observed)."""
    return (long_checks(shares(raw.members, member_conditions())).unionByName(
        long_checks(shares(raw.inpatient, inpatient_conditions(years)))).unionByName(long_checks(shares(raw.outpatient, outpatient_conditions()))))


def orphans(inpatient: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct claimants, how many of them have no member row, and the share."""
    claimants = inpatient.select(C.ID).distinct()
    known = members.select(F.col(C.ID).alias("_known")).distinct()
    matched = claimants.join(known, F.col(C.ID) == F.col("_known"), "left")
    return matched.agg(
        F.count(F.lit(1)).alias("n_claimants"), F.sum(F.col("_known").isNull().cast("bigint")).alias("n_orphans"),
        F.avg(F.col("_known").isNull().cast("int")).alias("share"))


def after_death(inpatient: DataFrame, members: DataFrame) -> DataFrame:
    """Decedents' claims of the file year, how many are dated after death, and the share.

    Claims are counted per member and date before the join, so a member with very many claims stays small.
    """
    claims = inpatient.groupBy(F.col(C.ID), F.col("CLM_FROM_DT").alias("_from")).agg(F.count(F.lit(1)).alias("_n"))
    claims = claims.withColumn("FILE_YEAR", year_of("_from").cast("int"))
    dead = members.filter(filled("BENE_DEATH_DT")).select(
        C.ID, F.col("FILE_YEAR").cast("int").alias("FILE_YEAR"), lenient_int("BENE_DEATH_DT").alias("_death"))
    late = (lenient_int("_from") > F.col("_death")).cast("int")
    return claims.join(dead, [C.ID, "FILE_YEAR"]).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_claims"), F.coalesce(F.sum(late * F.col("_n")), F.lit(0)).alias("n_late"),
    ).withColumn("share", F.try_divide(F.col("n_late").cast("double"), F.col("n_claims")))


def reconciliation(inpatient: DataFrame, members: DataFrame) -> DataFrame:
    """Per file year: member-summary and claim totals, their ratio, mean paid per member and its yearly change."""
    claims = inpatient.filter(filled("CLM_FROM_DT")).groupBy(
        F.col(C.ID), year_of("CLM_FROM_DT").cast("int").alias("FILE_YEAR")).agg(
        F.sum(lenient_real("CLM_PMT_AMT")).alias("_amount"))
    totals = members.select(
        C.ID, F.col("FILE_YEAR").cast("int").alias("FILE_YEAR"), lenient_real("MEDREIMB_IP").alias("_summary"),
        (lenient_real("MEDREIMB_IP") + lenient_real("MEDREIMB_OP") + lenient_real("MEDREIMB_CAR")).alias("_paid"))
    # the yearly mean rides on the same aggregation: one pass for totals and trend
    per_year = totals.join(claims, [C.ID, "FILE_YEAR"], "left").groupBy(F.col("FILE_YEAR").alias("year")).agg(
        F.sum("_summary").alias("summary_ip"), F.sum(F.coalesce("_amount", F.lit(0.0))).alias("claims_ip"),
        F.avg("_paid").alias("mean_paid"))
    per_year = per_year.withColumn("ratio_claims_to_summary", F.try_divide("claims_ip", "summary_ip"))
    return period_change(per_year, "year", "mean_paid", "yoy_change").select(
        "year", "summary_ip", "claims_ip", "ratio_claims_to_summary", "mean_paid", "yoy_change")


def yearly_trend(members: DataFrame) -> DataFrame:
    """Mean paid per member by file year with its relative change."""
    paid = lenient_real("MEDREIMB_IP") + lenient_real("MEDREIMB_OP") + lenient_real("MEDREIMB_CAR")
    means = members.groupBy(F.col("FILE_YEAR").cast("int").alias("year")).agg(F.avg(paid).alias("mean_paid"))
    return period_change(means, "year", "mean_paid", "yoy_change")


def run_suite(raw: RawTables, years: tuple[int, ...], recon: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """All eighteen checks as (check_id, category, description, observed, threshold, rule, status).

    ``seen``: values of the checks on single rows from :func:`stored`; without it they are counted by scans.
    """
    recon = reconciliation(raw.inpatient, raw.members) if recon is None else recon
    check_of_year = F.element_at(
        F.create_map(*[x for i, y in enumerate(years, start=1) for x in (F.lit(y), F.lit(f"DQ-{i:02d}"))]),
        F.col("year"))
    single = [seen] if seen is not None else [
        volumes(raw.members).select(check_of_year.alias("check_id"), F.col("n_rows").cast("double").alias("observed")), share_checks(raw, years)]
    parts = [
        *single,
        duplicates(raw).select("check_id", F.col("n_duplicates").cast("double").alias("observed")),
        orphans(raw.inpatient, raw.members).select(F.lit("DQ-15").alias("check_id"), F.col("share").alias("observed")),
        after_death(raw.inpatient, raw.members).select(
            F.lit("DQ-16").alias("check_id"), F.col("share").alias("observed")),
        long_checks(recon.agg(F.max(F.abs(F.col("ratio_claims_to_summary") - 1)).alias("DQ-17"),
                              F.max(F.abs("yoy_change")).alias("DQ-18"))),
    ]
    observed = parts[0]
    for part in parts[1:]:
        observed = observed.unionByName(part)
    return graded(observed, suite(years))
