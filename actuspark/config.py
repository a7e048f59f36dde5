"""Settings of the claims preset: years, thresholds, source layouts and feature lists."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column names of the raw member and claim files.
ID = "DESYNPUF_ID"
CHRONIC_COLUMNS = (
    "SP_ALZHDMTA", "SP_CHF", "SP_CHRNKIDN", "SP_CNCR", "SP_COPD", "SP_DEPRESSN",
    "SP_DIABETES", "SP_ISCHMCHT", "SP_OSTEOPRS", "SP_RA_OA", "SP_STRKETIA",
)
SETTINGS = ("IP", "OP", "CAR")
COVERAGE = {
    "part_a_mos": "BENE_HI_CVRAGE_TOT_MONS",
    "part_b_mos": "BENE_SMI_CVRAGE_TOT_MONS",
    "hmo_mos": "BENE_HMO_CVRAGE_TOT_MONS",
    "part_d_mos": "PLAN_CVRG_MOS_NUM",
}
DX_COLUMNS = tuple(f"ICD9_DGNS_CD_{i}" for i in range(1, 11))
HCPCS_COLUMNS = tuple(f"HCPCS_CD_{i}" for i in range(1, 6))

MEMBER_COLUMNS = (
    ID, "BENE_BIRTH_DT", "BENE_DEATH_DT", "BENE_SEX_IDENT_CD", "BENE_RACE_CD", "BENE_ESRD_IND",
    "SP_STATE_CODE", *COVERAGE.values(), *CHRONIC_COLUMNS,
    *(f"{kind}_{s}" for kind in ("MEDREIMB", "BENRES", "PPPYMT") for s in SETTINGS),
)
CLAIM_COLUMNS = (
    ID, "CLM_ID", "SEGMENT", "CLM_FROM_DT", "CLM_THRU_DT", "PRVDR_NUM", "CLM_PMT_AMT",
    "NCH_PRMRY_PYR_CLM_PD_AMT",
)
INPATIENT_COLUMNS = (
    *CLAIM_COLUMNS, "CLM_ADMSN_DT", "NCH_BENE_DSCHRG_DT", "CLM_UTLZTN_DAY_CNT", "CLM_DRG_CD", *DX_COLUMNS,
)
OUTPATIENT_COLUMNS = (*CLAIM_COLUMNS, *DX_COLUMNS, *HCPCS_COLUMNS)


@dataclass(frozen=True)
class CodeGroup:
    """A set of diagnosis codes: exact codes, case-insensitive prefixes, or a range of 3-character heads."""

    name: str
    prefixes: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    heads: tuple[str, str] | None = None


# ICD-9 groupings behind the dx_* features.
CODE_GROUPS = (
    CodeGroup("dx_diabetes", prefixes=("250",)),
    CodeGroup("dx_chf", prefixes=("428",), codes=(
        "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493")),
    CodeGroup("dx_copd", heads=("490", "496")),
    CodeGroup("dx_ckd", prefixes=("585", "403")),
    CodeGroup("dx_esrd", prefixes=("V451", "V56"), codes=("5856",)),
    CodeGroup("dx_cancer", heads=("140", "208")),
    CodeGroup("dx_ami_ihd", heads=("410", "414")),
    CodeGroup("dx_stroke", heads=("430", "438")),
    CodeGroup("dx_dementia", prefixes=("290", "3310", "294")),
    CodeGroup("dx_depression", prefixes=("311", "2962", "2963")),
    CodeGroup("dx_hypertension", heads=("401", "405")),
    CodeGroup("dx_afib", prefixes=("4273",)),
)

# Emergency-department procedure codes (inclusive range) and the slots they are looked up in.
ED_RANGE = ("99281", "99285")
ED_SLOTS = HCPCS_COLUMNS[:3]

# Labels and band edges (bands are open on the left, closed on the right).
RACE_LABELS = {1: "White", 2: "Black", 3: "Other", 5: "Hispanic"}
AGE_BANDS = ((0, 64, 69, 74, 79, 84, 200), ("<65", "65-69", "70-74", "75-79", "80-84", "85+"))
CHRONIC_BANDS = ((-1, 0, 2, 4, 20), ("0", "1-2", "3-4", "5+"))
PRIOR_COST_BANDS = ((-1, 0, 1000, 5000, 20000, 1e12), ("$0", "$1-1k", "$1k-5k", "$5k-20k", "$20k+"))

# Steps of the population waterfall.
WATERFALL_RULES = (
    "All beneficiaries in base-year summary file",
    "Alive at end of base year",
    "+ Part A or B coverage in base year",
    "+ Present in next-year summary file",
    "+ Part A or B coverage in next year (final)",
)
WATERFALL_FLAGS = ("elig_alive_end_of_base", "elig_base_coverage", "elig_in_next_year", "elig_next_coverage")

COST_FEATURES = ("paid_ip", "paid_op", "paid_car", "paid_total", "benres_total")
CHRONIC_FEATURES = tuple(c.lower() for c in CHRONIC_COLUMNS)
DX_FEATURES = tuple(g.name for g in CODE_GROUPS)
UTILISATION = ("ip_admits", "ip_days", "ip_readmit_30d", "op_visits", "er_visits", "n_providers", "n_distinct_dx")
FEATURES = (
    "age", "is_female", "esrd", *COVERAGE, *CHRONIC_FEATURES, "n_chronic",
    *COST_FEATURES, "log_paid_total", *UTILISATION, *DX_FEATURES,
)
TARGET = "target_paid"
LABEL = "target_high_cost"

# Model and sample names of the comparison tables.
M0, M1, M2, M3 = (
    "M0 Naive persistence", "M1 Demographic manual rate", "M2 Tweedie GLM", "M3 Gradient boosting (champion)")
C1, C2 = "C1 Logistic regression", "C2 Gradient boosting (champion)"
TRAIN, TEST = "Train", "Test (in-time)"
NORMALISED, RELATIVE = "OOT normalised", "OOT relative top 10%"


@dataclass(frozen=True)
class ClaimsConfig:
    """Years and thresholds of one run. The defaults are those of the public claims sample."""

    years: tuple[int, ...] = (2008, 2009, 2010)
    dev_year: int = 2008
    oot_year: int = 2009
    seed: int = 2024
    test_share: float = 0.30
    high_cost_quantile: float = 0.90
    features: tuple[str, ...] = field(default=FEATURES)

    @property
    def oot_sample(self) -> str:
        return f"OOT {self.oot_year}->{self.oot_year + 1}"
