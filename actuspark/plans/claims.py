"""Claims preset: raw member and claim tables to the year t -> t+1 modelling dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actuspark import config as C
from actuspark.functions.columns import (
    any_of, calendar_day, either, filled, flag, floored, labelled, band, larger, lenient_int, lenient_real,
    number_or_zero, or_else, row_sum, year_of,
)
from actuspark.operators import sequences, shaping
from actuspark.operators.ranking import quantile_value
from actuspark.session import compile_wide_rows, materialize
from actuspark.sources.readers import RawTables

KEYS = ["bene_id", "year"]
WHOLE = "int"


def member_year(members: DataFrame) -> DataFrame:
    """One typed row per member and year: demographics, coverage, condition flags and amounts."""
    compile_wide_rows(members.sparkSession)
    amount = lambda kind: row_sum(lenient_real(f"{kind}_{s}") for s in C.SETTINGS)
    conditions = {c: F.expr(f"CAST({c} = '1' AS int)") for c in C.CHRONIC_COLUMNS}
    death = F.when(filled("BENE_DEATH_DT"), lenient_int("BENE_DEATH_DT"))
    return members.select(
        F.col(C.ID).alias("bene_id"),
        F.col("FILE_YEAR").cast(WHOLE).alias("year"),
        (F.col("FILE_YEAR") - year_of("BENE_BIRTH_DT")).cast(WHOLE).alias("age"),
        F.when(F.col("BENE_SEX_IDENT_CD") == "2", 1).otherwise(0).alias("is_female"),
        lenient_int("BENE_RACE_CD").cast(WHOLE).alias("race_cd"),
        F.when(F.col("BENE_ESRD_IND") == "Y", 1).otherwise(0).alias("esrd"),
        lenient_int("SP_STATE_CODE").cast(WHOLE).alias("state_cd"),
        death.cast(WHOLE).alias("death_dt"),
        *[lenient_int(raw).cast(WHOLE).alias(name) for name, raw in C.COVERAGE.items()],
        *[c.alias(raw.lower()) for raw, c in conditions.items()],
        row_sum(conditions.values()).alias("n_chronic"),
        *[lenient_real(f"MEDREIMB_{s}").alias(f"paid_{s.lower()}") for s in C.SETTINGS],
        amount("MEDREIMB").alias("paid_total"),
        amount("BENRES").alias("benres_total"),
        amount("PPPYMT").alias("pppymt_total"),
    )


def inpatient_stays(inpatient: DataFrame) -> DataFrame:
    """Stays with dates, one row per distinct combination of the seven kept columns."""
    return inpatient.filter(filled("CLM_FROM_DT")).select(
        F.col(C.ID).alias("bene_id"), F.col("CLM_ID").alias("claim_id"),
        year_of("CLM_FROM_DT").cast(WHOLE).alias("year"),
        calendar_day(or_else("CLM_ADMSN_DT", "CLM_FROM_DT")).alias("admit_date"),
        calendar_day("CLM_THRU_DT").alias("discharge_date"),
        F.coalesce(lenient_int("CLM_UTLZTN_DAY_CNT"), F.lit(0)).cast(WHOLE).alias("util_days"),
        F.col("PRVDR_NUM").alias("provider"),
    ).distinct()


def readmissions(stays: DataFrame, hot_key_rows: int = sequences.HOT_KEY_ROWS,
                 counted: DataFrame | None = None) -> DataFrame:
    """Admissions within 30 days of the previous discharge, per member and year."""
    again = sequences.follow_ups(
        stays, "bene_id", "admit_date", "discharge_date", ["claim_id", "year", "util_days", "provider"],
        hot_key_rows=hot_key_rows, counted=counted)
    return again.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("ip_readmit_30d"))


def stay_utilisation(stays: DataFrame) -> DataFrame:
    """Admissions and days (the larger of billed days and length of stay) per member and year."""
    days = larger("util_days", F.date_diff("discharge_date", "admit_date"))
    # one row per claim first: both steps combine before they shuffle
    per_claim = stays.groupBy(*KEYS, "claim_id").agg(F.sum(days).alias("_days"))
    return per_claim.groupBy(*KEYS).agg(
        F.count("claim_id").alias("ip_admits"), F.sum("_days").alias("ip_days"))


def outpatient_visits(outpatient: DataFrame, ed_slots: tuple[str, ...] = C.ED_SLOTS) -> DataFrame:
    """Visits and emergency visits per member and year."""
    is_ed = flag(any_of(F.coalesce(F.col(s).between(*C.ED_RANGE), F.lit(False)) for s in ed_slots))
    claims = outpatient.filter(filled("CLM_FROM_DT")).select(
        F.col(C.ID).alias("bene_id"), year_of("CLM_FROM_DT").cast(WHOLE).alias("year"),
        F.col("CLM_ID").alias("claim_id"), is_ed.alias("_ed"))
    per_claim = claims.groupBy(*KEYS, "claim_id").agg(F.max("_ed").alias("_ed"))
    seen = F.col("claim_id").isNotNull()
    return per_claim.groupBy(*KEYS).agg(
        F.count("claim_id").alias("op_visits"),
        F.coalesce(F.sum(F.when(seen, F.col("_ed"))), F.lit(0)).alias("er_visits"))


def provider_counts(raw: RawTables) -> DataFrame:
    """Distinct providers over both claim types; claims without a date form a group with NULL year."""
    cols = [F.col(C.ID).alias("bene_id"), year_of("CLM_FROM_DT").cast(WHOLE).alias("year"),
            F.col("PRVDR_NUM").alias("provider")]
    both = raw.inpatient.select(cols).unionByName(raw.outpatient.select(cols))
    return shaping.distinct_counts(
        both.filter(F.col("provider").isNotNull()), KEYS, {"n_providers": F.col("provider")})


def diagnoses(raw: RawTables) -> DataFrame:
    """Distinct (member, year, code) over both claim types and all code slots."""
    cols = [F.col(C.ID).alias("bene_id"), F.col("CLM_FROM_DT").alias("_from"), *C.DX_COLUMNS]
    both = raw.inpatient.select(cols).unionByName(raw.outpatient.select(cols)).filter(filled("_from"))
    slim = both.select("bene_id", year_of("_from").cast(WHOLE).alias("year"), *C.DX_COLUMNS)
    return shaping.unpivot_codes(slim, KEYS, C.DX_COLUMNS, "dx").distinct()


def diagnosis_flags(dx: DataFrame) -> DataFrame:
    return shaping.code_group_flags(dx, KEYS, "dx", C.CODE_GROUPS, distinct="n_distinct_dx")


def next_year(members: DataFrame) -> DataFrame:
    """Member-years with the outcome columns of the following year."""
    return shaping.next_period(members, "bene_id", "year", {
        "target_year": "year", "target_paid": "paid_total", "target_paid_ip": "paid_ip",
        "target_part_a_mos": "part_a_mos", "target_part_b_mos": "part_b_mos", "target_death_dt": "death_dt",
    })


def with_eligibility(df: DataFrame) -> DataFrame:
    covered = lambda a, b: (F.col(a) > 0) | (F.col(b) > 0)
    after = (F.coalesce("target_part_a_mos", F.lit(0)) > 0) | (F.coalesce("target_part_b_mos", F.lit(0)) > 0)
    return df.select(
        "*",
        flag(F.col("target_year").isNotNull()).alias("elig_in_next_year"),
        flag(F.col("death_dt").isNull()).alias("elig_alive_end_of_base"),
        flag(covered("part_a_mos", "part_b_mos")).alias("elig_base_coverage"),
        flag(after).alias("elig_next_coverage"))


def model_base(raw: RawTables, cfg: C.ClaimsConfig, stays: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Member-years of the feature years with utilisation, diagnosis flags, outcome and eligibility flags.

    Every side is aggregated on (bene_id, year) before it is joined on the same keys, so each side arrives
    already partitioned for the join. The typed member table is stored once, because the join reads it twice;
    ``members`` may give it.
    """
    members = materialize(member_year(raw.members), "member_year") if members is None else members
    stays = inpatient_stays(raw.inpatient) if stays is None else stays
    base = next_year(members).filter(F.col("year").isin(cfg.dev_year, cfg.oot_year))
    sides = [
        stay_utilisation(stays),
        readmissions(stays, counted=raw.inpatient.select(F.col(C.ID).alias("bene_id"))),
        outpatient_visits(raw.outpatient), provider_counts(raw), diagnosis_flags(diagnoses(raw)),
    ]
    return with_eligibility(shaping.star_join(base, sides, KEYS))


def population_waterfall(base: DataFrame) -> DataFrame:
    return shaping.waterfall(base, "year", C.WATERFALL_FLAGS, C.WATERFALL_RULES)


def eligible(base: DataFrame) -> DataFrame:
    """The modelling dataset: rows that meet every eligibility rule."""
    keep = F.lit(True)
    for name in C.WATERFALL_FLAGS:
        keep = keep & (F.col(name) == 1)
    return base.filter(keep)


def floor_amounts(dataset: DataFrame) -> DataFrame:
    """Keep the raw outcome, floor outcome and prior amounts at 0, add the log of the prior total."""
    floors = {c: floored(c) for c in C.COST_FEATURES}
    return dataset.withColumns({
        "target_paid_raw": F.col(C.TARGET), C.TARGET: F.greatest(F.col(C.TARGET), F.lit(0.0)), **floors,
    }).withColumn("log_paid_total", F.log1p("paid_total"))


def count_negative_targets(dataset: DataFrame) -> DataFrame:
    """How many outcomes the floor changes."""
    return dataset.agg(F.coalesce(F.sum((F.col(C.TARGET) < 0).cast("bigint")), F.lit(0)).alias("n_negative"))


def feature_matrix(dataset: DataFrame, cfg: C.ClaimsConfig = C.ClaimsConfig()) -> DataFrame:
    """Floored dataset with every feature as a double without gaps."""
    compile_wide_rows(dataset.sparkSession)
    ready = floor_amounts(dataset)
    whole = {f.name for f in dataset.schema.fields if isinstance(f.dataType, T.IntegralType)}  # never NaN
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in whole - {*C.COST_FEATURES} else number_or_zero(c)
    return ready.select([known(c).alias(c) if c in cfg.features else F.col(c) for c in ready.columns])


def with_bands(df: DataFrame) -> DataFrame:
    """Reporting segments: age, sex, race, ESRD, chronic-count and prior-cost bands."""
    return df.withColumns({
        "age_band": band("age", *C.AGE_BANDS),
        "sex": either(F.col("is_female") == 1, "Female", "Male"),
        "race": labelled("race_cd", C.RACE_LABELS, "Unknown"),
        "esrd_status": either(F.col("esrd") == 1, "ESRD", "Non-ESRD"),
        "chronic_band": band("n_chronic", *C.CHRONIC_BANDS),
        "prior_cost_band": band("paid_total", *C.PRIOR_COST_BANDS),
    })


SEGMENTS = ("age_band", "sex", "race", "esrd_status", "chronic_band", "prior_cost_band")


@dataclass(frozen=True)
class Split:
    """Train, in-time test and out-of-time rows with the high-cost label, and its threshold from train."""

    train: DataFrame
    test: DataFrame
    oot: DataFrame
    threshold: float
    all_rows: DataFrame


def split(matrix: DataFrame, cfg: C.ClaimsConfig) -> Split:
    """Keyed-hash split of the development year; label = outcome at or above the train quantile."""
    tagged = shaping.hash_split(matrix, ["bene_id"], cfg.seed, cfg.test_share)
    role = F.when(F.col("year") == cfg.oot_year, F.lit(cfg.oot_sample)).when(
        F.col("is_test") == 1, F.lit(C.TEST)).otherwise(F.lit(C.TRAIN))
    tagged = tagged.filter(F.col("year").isin(cfg.dev_year, cfg.oot_year)).withColumn("sample", role).drop("is_test")
    threshold = quantile_value(tagged.filter(F.col("sample") == C.TRAIN), C.TARGET, cfg.high_cost_quantile)
    rows = tagged.withColumn(C.LABEL, (F.col(C.TARGET) >= F.lit(threshold)).cast("int"))
    part = lambda name: rows.filter(F.col("sample") == name)
    return Split(part(C.TRAIN), part(C.TEST), part(cfg.oot_sample), threshold, rows)
