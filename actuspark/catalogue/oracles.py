"""SQL counterparts of the registered queries, for checking results on another engine."""

from __future__ import annotations

import re

from actuspark import config as C
from actuspark.catalogue.shapes import finish_sql
from actuspark.operators import quality
from actuspark.plans import findings, starviews

CFG = starviews.STAR_CONFIG
OOT = CFG.oot_sample
YEARS = ", ".join(str(y) for y in CFG.years)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lint(x: str, junk: str = "0") -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN COALESCE(TRY_CAST(regexp_extract({x}, '^\\s*([+-]?\\d+)', 1) AS BIGINT), "
            f"{junk}) END")


def lreal(x: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN COALESCE(TRY_CAST(regexp_extract({x}, "
            f"'^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE), 0.0) END")


def day(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^\\d{{8}}') "
            f"AND TRY_CAST(substr({x}, 7, 2) AS INT) BETWEEN 1 AND 31 THEN "
            f"TRY_CAST(substr({x}, 1, 4) || '-' || substr({x}, 5, 2) || '-01' AS DATE) "
            f"+ CAST(TRY_CAST(substr({x}, 7, 2) AS INT) - 1 AS INT) END")


def hash_number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT)"


def band(x: str, edges, labels) -> str:
    parts = [f"WHEN {x} <= {e} THEN {q(label)}" for e, label in zip(edges[1:], labels)]
    return f"CASE WHEN {x} IS NULL OR {x} <= {edges[0]} OR {x} > {edges[-1]} THEN 'nan' {' '.join(parts)} END"


def code_test(g: C.CodeGroup) -> str:
    tests = [f"dx ILIKE {q(p + '%')}" for p in g.prefixes]
    if g.codes:
        tests.append(f"dx IN ({', '.join(q(c) for c in g.codes)})")
    if g.heads:
        tests.append(f"substr(dx, 1, 3) BETWEEN {q(g.heads[0])} AND {q(g.heads[1])}")
    return "(" + " OR ".join(tests) + ")"


def decile(rank: str, n: str, bins: int = 10) -> str:
    return f"greatest(1, (({rank} - 1) * {bins} + greatest({n} - 1, 1) - 1) // greatest({n} - 1, 1))"


KEYS = "bene_id, year"
PAID = " + ".join(lreal(f"MEDREIMB_{s}") for s in C.SETTINGS)
BIRTH = f"CASE WHEN BENE_BIRTH_DT IS NOT NULL THEN {lint('substr(BENE_BIRTH_DT, 1, 4)')} END"
CLAIM_YEAR = f"CAST({lint('substr(CLM_FROM_DT, 1, 4)')} AS INT)"
DATED = "CLM_FROM_DT IS NOT NULL AND CLM_FROM_DT <> ''"
SIDE_COLUMNS = [*C.UTILISATION, *C.DX_FEATURES]
ELIGIBLE = " AND ".join(f"{f} = 1" for f in C.WATERFALL_FLAGS)
FLAG_OF = {raw: f"CAST({raw} = '1' AS INT)" for raw in C.CHRONIC_COLUMNS}

VIEWS: dict[str, str] = dict(starviews.generic_views())

VIEWS["member_year"] = f"""
SELECT {C.ID} AS bene_id, FILE_YEAR AS year, FILE_YEAR - {BIRTH} AS age,
  CASE WHEN BENE_SEX_IDENT_CD = '2' THEN 1 ELSE 0 END AS is_female, {lint('BENE_RACE_CD')} AS race_cd,
  CASE WHEN BENE_ESRD_IND = 'Y' THEN 1 ELSE 0 END AS esrd, {lint('SP_STATE_CODE')} AS state_cd,
  CASE WHEN BENE_DEATH_DT <> '' THEN {lint('BENE_DEATH_DT')} END AS death_dt,
  {', '.join(f'{lint(raw)} AS {name}' for name, raw in C.COVERAGE.items())},
  {', '.join(f'{v} AS {raw.lower()}' for raw, v in FLAG_OF.items())},
  {' + '.join(FLAG_OF.values())} AS n_chronic,
  {', '.join(f"{lreal(f'MEDREIMB_{s}')} AS paid_{s.lower()}" for s in C.SETTINGS)},
  {PAID} AS paid_total,
  {' + '.join(lreal(f'BENRES_{s}') for s in C.SETTINGS)} AS benres_total,
  {' + '.join(lreal(f'PPPYMT_{s}') for s in C.SETTINGS)} AS pppymt_total
FROM stg_bene"""

VIEWS["ip_stay"] = f"""
SELECT DISTINCT {C.ID} AS bene_id, CLM_ID AS claim_id, {CLAIM_YEAR} AS year,
  {day("COALESCE(NULLIF(CLM_ADMSN_DT, ''), CLM_FROM_DT)")} AS admit_date, {day('CLM_THRU_DT')} AS discharge_date,
  COALESCE({lint("NULLIF(CLM_UTLZTN_DAY_CNT, '')")}, 0) AS util_days, PRVDR_NUM AS provider
FROM stg_ip WHERE {DATED}"""

VIEWS["ip_readmit"] = f"""
SELECT {KEYS}, COUNT(*) AS ip_readmit_30d FROM (
  SELECT {KEYS}, admit_date, lag(discharge_date) OVER (PARTITION BY bene_id ORDER BY admit_date NULLS FIRST,
    discharge_date NULLS FIRST, claim_id NULLS FIRST, year NULLS FIRST, util_days NULLS FIRST, provider NULLS FIRST) AS before
  FROM ip_stay) AS w
WHERE before IS NOT NULL AND date_diff('day', before, admit_date) BETWEEN 0 AND 30 GROUP BY ALL"""

VIEWS["ip_util"] = f"""
SELECT {KEYS}, COUNT(DISTINCT claim_id) AS ip_admits,
  SUM(CASE WHEN admit_date IS NOT NULL AND discharge_date IS NOT NULL
      THEN greatest(util_days, date_diff('day', admit_date, discharge_date)) END) AS ip_days
FROM ip_stay GROUP BY ALL"""

VIEWS["op_util"] = f"""
SELECT {C.ID} AS bene_id, {CLAIM_YEAR} AS year, COUNT(DISTINCT CLM_ID) AS op_visits,
  COUNT(DISTINCT CASE WHEN {' OR '.join(f"{s} BETWEEN '{C.ED_RANGE[0]}' AND '{C.ED_RANGE[1]}'" for s in C.ED_SLOTS)}
    THEN CLM_ID END) AS er_visits
FROM stg_op WHERE {DATED} GROUP BY ALL"""

VIEWS["prov_util"] = f"""
SELECT {KEYS}, COUNT(DISTINCT provider) AS n_providers FROM (
  SELECT {C.ID} AS bene_id, {CLAIM_YEAR} AS year, PRVDR_NUM AS provider FROM stg_ip
  UNION ALL SELECT {C.ID}, {CLAIM_YEAR}, PRVDR_NUM FROM stg_op) AS visited
WHERE provider IS NOT NULL GROUP BY ALL"""

VIEWS["dx_rows"] = f"""
SELECT DISTINCT {C.ID} AS bene_id, {CLAIM_YEAR} AS year, dx FROM (
  SELECT {C.ID}, CLM_FROM_DT, unnest([{', '.join(C.DX_COLUMNS)}]) AS dx FROM stg_ip
  UNION ALL SELECT {C.ID}, CLM_FROM_DT, unnest([{', '.join(C.DX_COLUMNS)}]) FROM stg_op) AS codes
WHERE dx IS NOT NULL AND dx <> '' AND {DATED}"""

VIEWS["dx_flags"] = f"""
SELECT {KEYS}, COUNT(DISTINCT dx) AS n_distinct_dx,
  {', '.join(f'MAX(CAST({code_test(g)} AS INT)) AS {g.name}' for g in C.CODE_GROUPS)}
FROM dx_rows GROUP BY {KEYS}"""

VIEWS["outcome"] = f"""
SELECT f.*, t.year AS target_year, t.paid_total AS target_paid, t.paid_ip AS target_paid_ip,
  t.part_a_mos AS target_part_a_mos, t.part_b_mos AS target_part_b_mos, t.death_dt AS target_death_dt,
  CAST(t.bene_id IS NOT NULL AS INT) AS elig_in_next_year, CAST(f.death_dt IS NULL AS INT) AS elig_alive_end_of_base,
  CAST(f.part_a_mos > 0 OR f.part_b_mos > 0 AS INT) AS elig_base_coverage,
  CAST(COALESCE(t.part_a_mos, 0) > 0 OR COALESCE(t.part_b_mos, 0) > 0 AS INT) AS elig_next_coverage
FROM member_year AS f LEFT JOIN member_year AS t ON t.bene_id = f.bene_id AND t.year = f.year + 1"""

VIEWS["base_rows"] = f"""
SELECT f.*, {', '.join(f'COALESCE({c}, 0) AS {c}' for c in SIDE_COLUMNS)}
FROM outcome AS f
LEFT JOIN ip_util AS a ON a.bene_id = f.bene_id AND a.year = f.year
LEFT JOIN ip_readmit AS b ON b.bene_id = f.bene_id AND b.year = f.year
LEFT JOIN op_util AS c ON c.bene_id = f.bene_id AND c.year = f.year
LEFT JOIN prov_util AS d ON d.bene_id = f.bene_id AND d.year = f.year
LEFT JOIN dx_flags AS e ON e.bene_id = f.bene_id AND e.year = f.year
WHERE f.year IN ({CFG.dev_year}, {CFG.oot_year})"""

VIEWS["waterfall"] = " UNION ALL ".join(
    f"SELECT year AS feature_year, {i} AS step, {q(rule)} AS rule, "
    + ("COUNT(*)" if i == 1 else f"SUM({' * '.join(C.WATERFALL_FLAGS[:i - 1])})") + " AS n FROM base_rows GROUP BY year"
    for i, rule in enumerate(C.WATERFALL_RULES, start=1))

_FLOORED = ", ".join([f"greatest({C.TARGET}, 0.0) AS {C.TARGET}",
                      *[f"greatest(COALESCE({c}, 0.0), 0.0) AS {c}" for c in C.COST_FEATURES]])
_FILLED = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in ("n_chronic", *C.CHRONIC_FEATURES))
VIEWS["people"] = f"""
SELECT * REPLACE ({_FLOORED}, {_FILLED}), {C.TARGET} AS target_paid_raw FROM outcome
WHERE year IN ({CFG.dev_year}, {CFG.oot_year}) AND {ELIGIBLE}"""
VIEWS["matrix"] = f"""
SELECT * REPLACE ({', '.join(f'CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}' for c in C.FEATURES if c != 'log_paid_total')}),
  ln(1 + paid_total) AS log_paid_total
FROM (SELECT * REPLACE ({_FLOORED}) FROM base_rows WHERE {ELIGIBLE}) AS kept"""


def _samples(source: str) -> str:
    share = f"CAST({hash_number(f'bene_id || {q(f'|{CFG.seed}')}')} AS DOUBLE) / 4294967296.0"
    return f"""SELECT *, CASE WHEN year = {CFG.oot_year} THEN {q(OOT)} WHEN {share} < {CFG.test_share} THEN {q(C.TEST)}
  ELSE {q(C.TRAIN)} END AS sample FROM {source}"""


VIEWS["sampled"] = _samples("people")
VIEWS["cutoff"] = (f"SELECT quantile_cont({C.TARGET}, {CFG.high_cost_quantile}) AS threshold FROM sampled "
                   f"WHERE sample = {q(C.TRAIN)}")
VIEWS["labelled"] = f"SELECT s.*, CAST({C.TARGET} >= threshold AS INT) AS {C.LABEL} FROM sampled AS s, cutoff"
VIEWS["msampled"] = _samples("matrix")


def money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(24,4))) AS DOUBLE)"


VIEWS["m0"] = f"""
SELECT {money(C.TARGET)} / greatest({money('paid_total')}, 1.0) AS trend, {money(C.TARGET)} / COUNT(*) * 0.25 AS floor_
FROM labelled WHERE sample = {q(C.TRAIN)}"""
AGE_CELL = band("age", *C.AGE_BANDS)


def rates(target: str) -> str:
    return f"""
SELECT age_cell, is_female AS sex_cell, esrd AS esrd_cell, m AS cell_mean, n, n / (n + 200) * m + (1 - n / (n + 200)) * mu AS rate, mu
FROM (SELECT {AGE_CELL} AS age_cell, is_female, esrd, {money(target)} / COUNT(*) AS m, CAST(COUNT(*) AS DOUBLE) AS n
      FROM labelled WHERE sample = {q(C.TRAIN)} GROUP BY 1, 2, 3) AS c,
  (SELECT {money(target)} / COUNT(*) AS mu FROM labelled WHERE sample = {q(C.TRAIN)}) AS g"""


def with_rate(source: str, table: str, out: str) -> str:
    return f"""SELECT s.*, COALESCE(r.rate, g.mu) AS {out} FROM {source} AS s
LEFT JOIN {table} AS r ON r.age_cell = {AGE_CELL.replace('age ', 's.age ')} AND r.sex_cell = s.is_female AND r.esrd_cell = s.esrd
CROSS JOIN (SELECT DISTINCT mu FROM {table}) AS g"""


VIEWS["cost_rates"] = rates(C.TARGET)
VIEWS["class_rates"] = rates(C.LABEL)
VIEWS["scored"] = with_rate(
    "(SELECT l.*, greatest(paid_total * trend, floor_) AS p FROM labelled AS l, m0)", "class_rates", "q")


# ---- metric building blocks over a view with the columns (grp, id, y, p)

def reg_sql(src: str) -> str:
    area = lambda score: (f"SUM(y * (n - {score} + 1)) / SUM(y) / COUNT(*) - (COUNT(*) + 1) / (2.0 * COUNT(*))")
    return f"""
WITH t AS (SELECT grp, COUNT(*) AS n, AVG(y) AS my, quantile_cont(p, 0.9) AS cut FROM ({src}) AS s GROUP BY grp),
r AS (SELECT s.*, n, my, cut, row_number() OVER (PARTITION BY s.grp ORDER BY p DESC, id) AS rp,
        row_number() OVER (PARTITION BY s.grp ORDER BY y DESC, id) AS ry FROM ({src}) AS s JOIN t ON t.grp = s.grp)
SELECT grp, COUNT(*) AS n, 1 - SUM((y - p) * (y - p)) / SUM((y - my) * (y - my)) AS r2,
  1 - SUM(abs(y - p)) / SUM(abs(y - my)) AS cpm, AVG(abs(y - p)) AS mae, sqrt(AVG((y - p) * (y - p))) AS rmse,
  SUM(p) / SUM(y) AS predictive_ratio, ({area('rp')}) / ({area('ry')}) AS gini,
  SUM(CASE WHEN p >= cut THEN y ELSE 0 END) / SUM(y) AS top_capture, AVG(y) AS mean_actual, AVG(p) AS mean_predicted
FROM r GROUP BY grp"""


def auc_sql(src: str, weight: str = "1") -> str:
    """Tie-averaged rank form per group."""
    return f"""
SELECT grp, SUM(neg * (above + pos / 2.0)) / (SUM(pos) * SUM(neg)) AS auc, CAST(SUM(pos) AS BIGINT) AS n_pos,
  CAST(SUM(neg) AS BIGINT) AS n_neg, greatest(MAX((above + pos) / tp - (below + neg) / tn), 0.0) AS ks
FROM (SELECT *, COALESCE(SUM(pos) OVER w, 0) AS above, COALESCE(SUM(neg) OVER w, 0) AS below,
        SUM(pos) OVER (PARTITION BY grp) AS tp, SUM(neg) OVER (PARTITION BY grp) AS tn
      FROM (SELECT grp, p, CAST(SUM(y * {weight}) AS DOUBLE) AS pos, CAST(SUM((1 - y) * {weight}) AS DOUBLE) AS neg
            FROM ({src}) AS s GROUP BY grp, p) AS v
      WINDOW w AS (PARTITION BY grp ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS c
GROUP BY grp"""


def binned_sql(src: str) -> str:
    return f"""
SELECT *, {decile('rk', 'n')} AS bin FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS rk, COUNT(*) OVER (PARTITION BY grp) AS n
  FROM ({src}) AS s) AS r"""


def hl_sql(src: str) -> str:
    return f"""
SELECT grp, hl_stat, exp(-hl_stat / 2) * (1 + hl_stat / 2 + pow(hl_stat / 2, 2) / 2 + pow(hl_stat / 2, 3) / 6) AS hl_pvalue
FROM (SELECT grp, SUM((o - e) * (o - e) / (e * (1 - e / m))) AS hl_stat FROM (
  SELECT grp, bin, SUM(y) AS o, SUM(p) AS e, COUNT(*) AS m FROM ({binned_sql(src)}) AS b GROUP BY grp, bin) AS t
GROUP BY grp) AS h"""


def clf_sql(src: str) -> str:
    return f"""
WITH cuts AS (SELECT grp, quantile_cont(p, 0.9) AS cut FROM ({src}) AS s GROUP BY grp),
m AS (SELECT s.grp, COUNT(*) AS n, AVG((p - y) * (p - y)) AS brier, AVG(y) AS event_rate, AVG(p) AS mean_probability,
        SUM(y) AS pos, SUM(CASE WHEN p >= cut THEN y ELSE 0 END) AS hit, SUM(CASE WHEN p >= cut THEN 1.0 ELSE 0.0 END) AS flagged
      FROM ({src}) AS s JOIN cuts ON cuts.grp = s.grp GROUP BY s.grp)
SELECT m.grp, n, auc, 2 * auc - 1 AS gini, ks, brier, hit / flagged AS precision_top, hit / pos AS recall_top,
  hit / flagged / event_rate AS lift_top, hl_stat, hl_pvalue, event_rate, mean_probability
FROM m JOIN ({auc_sql(src)}) AS a ON a.grp = m.grp JOIN ({hl_sql(src)}) AS h ON h.grp = m.grp"""


def psi_sql(expected: str, actual: str) -> str:
    """Bin table from views with the columns (grp, v)."""
    marks = ", ".join(str(i / 10) for i in range(11))
    return f"""
WITH e AS (SELECT grp, list_sort(list_distinct(list_transform(quantile_cont(v, [{marks}]), lambda x: round(x, 6)))) AS cuts
           FROM ({expected}) AS s GROUP BY grp),
inner_ AS (SELECT grp, len(cuts) - 1 AS n_bins, CASE WHEN len(cuts) > 2 THEN cuts[2:len(cuts) - 1] ELSE CAST([] AS DOUBLE[]) END AS edges FROM e),
rows_ AS (SELECT s.grp, side, 1 + len(list_filter(edges, lambda x: x <= v)) AS bin FROM (
  SELECT grp, v, 1 AS side FROM ({expected}) AS a UNION ALL SELECT grp, v, 0 FROM ({actual}) AS b) AS s
  JOIN inner_ ON inner_.grp = s.grp),
counts AS (SELECT grp, bin, SUM(side) AS ne, SUM(1 - side) AS na FROM rows_ GROUP BY grp, bin),
whole AS (SELECT grp, SUM(ne) AS te, SUM(na) AS ta FROM counts GROUP BY grp),
grid AS (SELECT grp, edges, n_bins, unnest(range(1, n_bins + 1)) AS bin FROM inner_ WHERE n_bins > 0),
shares AS (SELECT g.grp, g.bin, n_bins, CASE WHEN g.bin > 1 THEN edges[g.bin - 1] END AS lower,
    CASE WHEN g.bin < n_bins THEN edges[g.bin] END AS upper,
    greatest(COALESCE(ne, 0) / te, 0.000001) AS expected_pct, greatest(COALESCE(na, 0) / ta, 0.000001) AS actual_pct
  FROM grid AS g LEFT JOIN counts AS c ON c.grp = g.grp AND c.bin = g.bin JOIN whole AS w ON w.grp = g.grp)
SELECT *, (actual_pct - expected_pct) * ln(actual_pct / expected_pct) AS psi_contrib FROM shares"""


def csi_sql(train: str, test: str, oot: str, features) -> str:
    names = ", ".join(features)
    long = lambda src: f"SELECT name AS grp, value AS v FROM (UNPIVOT (SELECT {names} FROM ({src}) AS u) ON {names} INTO NAME name VALUE value)"
    spread = f"SELECT grp AS feature FROM ({long(train)}) AS t GROUP BY grp HAVING MIN(v) < MAX(v)"
    found = f"SELECT grp, SUM(psi_contrib) AS csi, COUNT(*) AS n_bins FROM ({psi_sql(long(test), long(oot))}) AS b GROUP BY grp"
    return (f"SELECT feature, COALESCE(csi, 0.0) AS csi, COALESCE(n_bins, 0) AS n_bins FROM ({spread}) AS s "
            f"LEFT JOIN ({found}) AS f ON f.grp = s.feature")


SCORED_P = f"SELECT sample AS grp, bene_id AS id, {C.TARGET} AS y, p FROM scored"
SCORED_Q = f"SELECT sample AS grp, bene_id AS id, {C.LABEL} AS y, q AS p FROM scored"
only = lambda src, name: f"SELECT * FROM ({src}) AS o WHERE grp = {q(name)}"
SEX = "CASE WHEN is_female = 1 THEN 'Female' ELSE 'Male' END"
RACE = "CASE race_cd " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in C.RACE_LABELS.items())
BANDS = (f"{band('age', *C.AGE_BANDS)} AS age_band, {SEX} AS sex, {RACE} ELSE 'Unknown' END AS race, "
         f"CASE WHEN esrd = 1 THEN 'ESRD' ELSE 'Non-ESRD' END AS esrd_status, "
         f"{band('n_chronic', *C.CHRONIC_BANDS)} AS chronic_band, "
         f"{band('paid_total', *C.PRIOR_COST_BANDS)} AS prior_cost_band")
SEGMENTS = ("age_band", "sex", "race", "esrd_status", "chronic_band", "prior_cost_band")
VIEWS["banded"] = f"""
SELECT *, {BANDS}, p * (SUM({C.TARGET}) OVER () / SUM(p) OVER ()) AS p_norm FROM scored WHERE sample = {q(OOT)}"""
VIEWS["segs"] = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS level, COUNT(*) AS n, AVG({C.TARGET}) AS actual_mean, AVG(p_norm) AS pred_mean, "
    f"SUM(p_norm) / greatest(SUM({C.TARGET}), 1.0) AS predictive_ratio FROM banded GROUP BY {d}" for d in SEGMENTS)
_FAIR_SRC = (f"SELECT 'race' || '|' || ({RACE} ELSE CAST(race_cd AS VARCHAR) END) AS grp, bene_id AS id, {C.LABEL} AS y, p "
             f"FROM scored WHERE sample = {q(OOT)} AND race_cd IS NOT NULL UNION ALL SELECT 'sex|' || {SEX}, bene_id, {C.LABEL}, p "
             f"FROM scored WHERE sample = {q(OOT)}")
VIEWS["fair"] = f"""
SELECT split_part(m.grp, '|', 1) AS dimension, split_part(m.grp, '|', 2) AS level, n, event_rate, auc, flag_rate_top, tpr_top
FROM (SELECT grp, COUNT(*) AS n, AVG(y) AS event_rate, AVG(CAST(p >= cut AS INT)) AS flag_rate_top,
        SUM(CASE WHEN p >= cut THEN y ELSE 0 END) / greatest(SUM(y), 1) AS tpr_top
      FROM ({_FAIR_SRC}) AS s, (SELECT quantile_cont(p, 0.9) AS cut FROM scored WHERE sample = {q(OOT)}) AS c GROUP BY grp) AS m
JOIN ({auc_sql(_FAIR_SRC)}) AS a ON a.grp = m.grp WHERE n_pos > 0 AND n_neg > 0"""
VIEWS["mono"] = f"""
SELECT level, mean_pred, mean_pred - lag(mean_pred) OVER (ORDER BY level) AS step FROM (
  SELECT least(n_chronic, 8) AS level, AVG(p) AS mean_pred FROM scored WHERE sample = {q(OOT)}
  GROUP BY 1) AS m"""
VIEWS["roster"] = f"""
SELECT *, {decile('rk', 'n')} AS risk_decile FROM (
  SELECT *, row_number() OVER (ORDER BY predicted_cost, bene_id) AS rk, COUNT(*) OVER () AS n FROM (
    SELECT bene_id, age_band, sex, race, CASE WHEN esrd = 1 THEN 'Y' ELSE 'N' END AS esrd, n_chronic,
      paid_total AS prior_year_paid, round(p, 2) AS predicted_cost, {C.TARGET} AS actual_cost,
      round(q, 4) AS hcc_probability, {C.LABEL} AS hcc_actual FROM banded) AS b) AS r"""
VIEWS["backtest"] = """
WITH d AS (SELECT risk_decile, COUNT(*) AS members, SUM(predicted_cost) AS predicted, SUM(actual_cost) AS actual,
             SUM(hcc_actual) AS hcc FROM roster GROUP BY risk_decile),
t AS (SELECT SUM(members) AS members, SUM(predicted) AS predicted, SUM(actual) AS actual, SUM(hcc) AS hcc FROM d)
SELECT x.*, x.predicted / x.members AS mean_predicted, x.actual / x.members AS mean_actual,
  x.predicted / x.actual AS predictive_ratio, share AS cumulative_cost_share, x.hcc / x.members AS hcc_rate,
  x.predicted / x.actual * (t.actual / t.predicted) AS normalised_ratio
FROM (SELECT d.*, SUM(d.actual) OVER (ORDER BY risk_decile) / t.actual AS share FROM d, t
      UNION ALL SELECT 0, members, predicted, actual, hcc, NULL FROM t) AS x, t"""


def _share(check: str, cond: str, table: str) -> str:
    return f"SELECT '{check}' AS check_id, AVG(CAST({cond} AS INT)) AS observed FROM {table}"


_AMOUNT_NEG = " OR ".join(f"{lreal(f'MEDREIMB_{s}')} < 0" for s in C.SETTINGS)
VIEWS["dq_share_rows"] = " UNION ALL ".join([
    _share("DQ-07", "(BENE_BIRTH_DT IS NULL OR BENE_BIRTH_DT = '')", "stg_bene"),
    _share("DQ-08", f"(FILE_YEAR - {BIRTH} NOT BETWEEN 18 AND 110)", "stg_bene"),
    _share("DQ-09", f"({_AMOUNT_NEG})", "stg_bene"),
    _share("DQ-10", f"({lreal('CLM_PMT_AMT')} < 0)", "stg_ip"),
    _share("DQ-11", f"({lint('CLM_THRU_DT')} < {lint('CLM_FROM_DT')})", f"stg_ip WHERE {DATED}"),
    _share("DQ-12", "(CLM_FROM_DT IS NULL OR CLM_FROM_DT = '')", "stg_op"),
    _share("DQ-13", f"(substr(CLM_FROM_DT, 1, 4) NOT IN ({', '.join(q(str(y)) for y in CFG.years)}))", f"stg_ip WHERE {DATED}"),
    _share("DQ-14", f"({C.DX_COLUMNS[0]} IS NULL OR {C.DX_COLUMNS[0]} = '')", "stg_op")])
_dup = lambda check, table, keys: (
    f"SELECT '{check}' AS check_id, COUNT(*) AS n_duplicates FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING COUNT(*) > 1) AS x")
VIEWS["dq_dups"] = " UNION ALL ".join([
    _dup("DQ-04", "stg_bene", f"{C.ID}, FILE_YEAR"), _dup("DQ-05", "stg_ip", "CLM_ID, SEGMENT"),
    _dup("DQ-06", "stg_op", "CLM_ID, SEGMENT")])
VIEWS["dq_orphan"] = f"""
SELECT COUNT(*) AS n_claimants, SUM(CAST(b.{C.ID} IS NULL AS INT)) AS n_orphans, AVG(CAST(b.{C.ID} IS NULL AS INT)) AS share
FROM (SELECT DISTINCT {C.ID} FROM stg_ip) AS c LEFT JOIN (SELECT DISTINCT {C.ID} FROM stg_bene) AS b ON b.{C.ID} = c.{C.ID}"""
VIEWS["dq_death"] = f"""
SELECT COUNT(*) AS n_claims, COALESCE(SUM(late), 0) AS n_late, AVG(late) AS share FROM (
  SELECT CAST({lint('i.CLM_FROM_DT')} > {lint('b.BENE_DEATH_DT')} AS INT) AS late FROM stg_ip AS i
  JOIN stg_bene AS b ON b.{C.ID} = i.{C.ID} AND b.FILE_YEAR = {CLAIM_YEAR} WHERE b.BENE_DEATH_DT <> '') AS x"""
VIEWS["trend"] = f"""
SELECT year, mean_paid, mean_paid / lag(mean_paid) OVER (ORDER BY year) - 1 AS yoy_change FROM (
  SELECT FILE_YEAR AS year, AVG({PAID}) AS mean_paid FROM stg_bene GROUP BY 1) AS m"""
VIEWS["recon"] = f"""
SELECT r.year, summary_ip, claims_ip, claims_ip / summary_ip AS ratio_claims_to_summary, mean_paid, yoy_change FROM (
  SELECT FILE_YEAR AS year, SUM({lreal('MEDREIMB_IP')}) AS summary_ip, SUM(COALESCE(amount, 0)) AS claims_ip
  FROM stg_bene AS b LEFT JOIN (
    SELECT {C.ID} AS id, {CLAIM_YEAR} AS yr, SUM({lreal('CLM_PMT_AMT')}) AS amount FROM stg_ip WHERE {DATED} GROUP BY 1, 2) AS c
  ON c.id = b.{C.ID} AND c.yr = b.FILE_YEAR GROUP BY 1) AS r JOIN trend ON trend.year = r.year"""
_checks = ", ".join(
    f"({q(c.check_id)}, {q(c.category)}, {q(c.description)}, {float(c.threshold)}, {q(c.rule)})" for c in quality.suite(CFG.years))
VIEWS["dq_all"] = f"""
SELECT k.*, round(COALESCE(v, 0.0), 4) AS observed,
  CASE WHEN rule <> 'max' THEN 'INFO' WHEN COALESCE(v, 0.0) <= threshold THEN 'PASS' WHEN COALESCE(v, 0.0) <= threshold * 5 THEN 'WARN' ELSE 'FAIL' END AS status
FROM (VALUES {_checks}) AS k(check_id, category, description, threshold, rule) LEFT JOIN (
  SELECT 'DQ-0' || CAST(FILE_YEAR - {CFG.years[0] - 1} AS VARCHAR) AS id, CAST(COUNT(*) AS DOUBLE) AS v FROM stg_bene GROUP BY 1
  UNION ALL SELECT check_id, n_duplicates FROM dq_dups UNION ALL SELECT check_id, observed FROM dq_share_rows
  UNION ALL SELECT 'DQ-15', share FROM dq_orphan UNION ALL SELECT 'DQ-16', share FROM dq_death
  UNION ALL SELECT 'DQ-17', MAX(abs(ratio_claims_to_summary - 1)) FROM recon
  UNION ALL SELECT 'DQ-18', MAX(abs(yoy_change)) FROM recon) AS o ON o.id = k.check_id"""

# persistence (champion) against cell rates, samples plus the normalised one
VIEWS["duel"] = f"""
SELECT {q(C.M0)} AS model, sample, bene_id AS id, {C.TARGET} AS y, p FROM scored
UNION ALL SELECT {q(C.M1)}, sample, bene_id, {C.TARGET}, c FROM ({with_rate('scored', 'cost_rates', 'c')}) AS s"""
VIEWS["duel_rows"] = f"""
SELECT model || '|' || sample AS grp, id, y, p FROM duel UNION ALL
SELECT model || '|{C.NORMALISED}', id, y, p * (SUM(y) OVER (PARTITION BY model) / SUM(p) OVER (PARTITION BY model))
FROM duel WHERE sample = {q(OOT)}"""


def _pick(model: str, sample: str, cols: dict[str, str]) -> str:
    return ", ".join(f"MAX(CASE WHEN grp = {q(model + '|' + sample)} THEN {c} END) AS {out}" for out, c in cols.items())


VIEWS["duel_facts"] = f"""
SELECT {_pick(C.M0, C.TRAIN, {'tr_r2': 'r2'})},
  {_pick(C.M0, C.TEST, {'t_r2': 'r2', 't_pr': 'predictive_ratio', 't_gini': 'gini'})},
  {_pick(C.M0, OOT, {'o_pr': 'predictive_ratio', 'o_ma': 'mean_actual', 'o_mp': 'mean_predicted'})},
  {_pick(C.M0, C.NORMALISED, {'on_r2': 'r2', 'on_gini': 'gini', 'on_cpm': 'cpm'})},
  {_pick(C.M1, C.NORMALISED, {'ch_cpm': 'cpm'})},
  (SELECT observed FROM dq_all WHERE check_id = 'DQ-18') AS yoy, (SELECT SUM(psi_contrib) FROM score_psi) AS psi
FROM ({reg_sql('SELECT * FROM duel_rows')}) AS m"""
_sample_v = lambda name: f"SELECT 'all' AS grp, p AS v FROM scored WHERE sample = {q(name)}"
VIEWS["score_psi"] = psi_sql(_sample_v(C.TEST), _sample_v(OOT))
VIEWS["feature_csi"] = csi_sql(*[f"SELECT * FROM msampled WHERE sample = {q(s)}" for s in (C.TRAIN, C.TEST, OOT)], C.FEATURES)


_CELLS = {"age_cell": AGE_CELL, "sex_cell": "is_female", "esrd_cell": "esrd"}


def _refit(name: str, kind: str, cells: dict[str, str], k: int = 200, rows: str = "TRUE") -> str:
    train = f"SELECT {C.TARGET} AS y, {', '.join(f'{v} AS {c}' for c, v in cells.items())} FROM labelled WHERE sample = {q(C.TRAIN)} AND {rows}"
    keys = ", ".join(cells)
    return f"""SELECT {q(name)} AS grp, {q(kind)} AS kind, o.bene_id AS id, o.{C.TARGET} AS y, COALESCE(r.n / (r.n + {k}) * r.m + {k} / (r.n + {k}) * g.mu, g.mu) AS p
FROM (SELECT *, {', '.join(f'{v} AS {c}' for c, v in cells.items())} FROM labelled WHERE sample = {q(OOT)}) AS o
LEFT JOIN (SELECT {keys}, {money('y')} / COUNT(*) AS m, CAST(COUNT(*) AS DOUBLE) AS n FROM ({train}) AS t GROUP BY {keys}) AS r USING ({keys})
CROSS JOIN (SELECT {money('y')} / COUNT(*) AS mu FROM ({train}) AS t) AS g"""


VIEWS["bench_rows"] = " UNION ALL ".join([
    *(_refit(f"Seed {s}", "seed", _CELLS, rows=f"CAST({hash_number(f'bene_id || {q(f'|refit|{s}')}')} AS DOUBLE) / 4294967296.0 < 0.8") for s in range(1, 6)),
    *(_refit(f"k={k}", "hyperparameter", _CELLS, k) for k in (50, 800)),
    *(_refit(f"Drop {c}", "ablation", {x: v for x, v in _CELLS.items() if x != c}) for c in _CELLS)])
VIEWS["bench_metrics"] = f"""
SELECT m.*, f.kind, f.raw FROM (SELECT grp, kind, SUM(p) / SUM(y) AS raw FROM bench_rows GROUP BY grp, kind) AS f JOIN (
{reg_sql("SELECT grp, id, y, p * (SUM(y) OVER (PARTITION BY grp) / SUM(p) OVER (PARTITION BY grp)) AS p FROM bench_rows")}) AS m ON m.grp = f.grp"""


def _finding(rule: int, area: str, severity: str, finding: str, evidence: str, source: str, order: str = "''") -> str:
    return (f"SELECT {rule} AS rule_, {order} AS order_, {q(area)} AS area, {severity} AS severity, {finding} AS finding, "
            f"{evidence} AS evidence FROM {source}")


_OA, _CS = "Outcome analysis", "Conceptual soundness"
VIEWS["found"] = " UNION ALL ".join([
    _finding(1, "Data quality", "CASE WHEN status = 'FAIL' THEN 'Medium' ELSE 'Low' END", "check_id || ': ' || description",
             "printf('Observed %.4f against threshold %.4f', observed, threshold)",
             "dq_all WHERE status IN ('FAIL', 'WARN')", "check_id"),
    _finding(2, _OA, "CASE WHEN abs(o_pr - 1) > 0.10 THEN 'High' ELSE 'Medium' END", "'Out-of-time totals outside the 5 % tolerance'",
             "printf('Predictive ratio %.3f out of time, %.3f in time; mean actual %.2f, predicted %.2f.', o_pr, t_pr, o_ma, o_mp) "
             "|| CASE WHEN yoy > 0.15 THEN printf(' Mean paid per member moved by %.1f %% in a year (DQ-18) while the score PSI is "
             "%.3f: look for incomplete outcome-year claims. Normalised R2 %.3f, Gini %.3f.', yoy * 100, psi, on_r2, on_gini) "
             "ELSE '' END", "duel_facts WHERE abs(o_pr - 1) > 0.05"),
    _finding(3, _OA, "'Medium'", "'Explanatory power falls out of time, also after normalisation'",
             "printf('R2 %.3f in time, %.3f out of time; Gini %.3f and %.3f', t_r2, on_r2, t_gini, on_gini)",
             "duel_facts WHERE t_r2 > 0 AND (t_r2 - on_r2) / t_r2 > 0.15"),
    _finding(4, _CS, "'Medium'", "'Signs of over-fitting'", "printf('R2 %.3f on train, %.3f on test', tr_r2, t_r2)",
             "duel_facts WHERE tr_r2 - t_r2 > 0.10"),
    _finding(5, "Stability", "CASE WHEN psi > 0.25 THEN 'High' ELSE 'Medium' END", "'Score distribution has shifted'",
             "printf('Score PSI %.3f', psi)", "duel_facts WHERE psi > 0.10"),
    _finding(6, "Stability", "CASE WHEN worst > 0.25 THEN 'Medium' ELSE 'Low' END",
             "'Feature distributions have shifted (CSI above 0.10)'", "line",
             "(SELECT string_agg(printf('%s=%.2f', feature, csi), ', ' ORDER BY csi DESC, feature) AS line, MAX(csi) AS worst "
             "FROM (SELECT * FROM feature_csi WHERE csi > 0.10 ORDER BY csi DESC, feature LIMIT 5) AS t) AS s WHERE line IS NOT NULL"),
    _finding(7, _OA, "'Medium'", "'Segments mis-calibrated (ratio outside 0.85-1.15)'", "line",
             "(SELECT string_agg(printf('%s=%s: %.2f', dimension, level, predictive_ratio), '; ' ORDER BY dimension, level) AS line "
             "FROM (SELECT * FROM segs WHERE n >= 500 AND (predictive_ratio < 0.85 OR predictive_ratio > 1.15) "
             "ORDER BY dimension, level LIMIT 6) AS t) AS s WHERE line IS NOT NULL"),
    _finding(8, "Fairness", "'Medium'", "'AUC differs between race groups'", "printf('AUC from %.3f to %.3f', low, high)",
             "(SELECT MIN(auc) AS low, MAX(auc) AS high, COUNT(*) AS k FROM fair WHERE dimension = 'race') AS s "
             "WHERE k > 1 AND high - low > 0.05"),
    _finding(9, "Benchmarking", "'Low'", "'Champion hardly better than the simpler challenger'",
             "printf('Normalised CPM %.3f against %.3f', on_cpm, ch_cpm)", "duel_facts WHERE on_cpm - ch_cpm < 0.01"),
    _finding(10, "Robustness", "'Low'", "'Results depend on the seed'", "printf('Deviation of out-of-time R2 over seeds %.4f', spread)",
             "(SELECT stddev_samp(r2) AS spread FROM bench_metrics WHERE kind = 'seed') AS s WHERE spread > 0.01"),
    _finding(11, _CS, "'Medium'", "'Prediction not monotonic in the chronic-condition count'", "'See the monotonicity table'",
             "(SELECT MIN(step) AS fall, AVG(mean_pred) AS level FROM mono) AS s WHERE fall <= -0.02 * level"),
    _finding(12, _CS, "'Low'", "'Public sample limits clinical credibility'",
             "'Values of the public sample are perturbed; carrier and drug detail is not used for features.'", "(SELECT 1) AS s"),
    _finding(13, "Implementation", "'Low'", "'A monitoring plan is required'",
             "'The model has not been monitored in production.'", "(SELECT 1) AS s"),
])

# 2^32 times the distribution function of a Poisson variable of mean 1, rounded up
POISSON_CUTS = [1580030169, 3160060338, 3950075422, 4213413784, 4279248374, 4292415292, 4294609778, 4294923277, 4294962464]
_weights = " + ".join(f"CAST(draw >= {c} AS INT)" for c in POISSON_CUTS)
VIEWS["replicates"] = f"""
SELECT r AS grp, y, label, p, q, {_weights} AS w FROM (
  SELECT r, {C.TARGET} AS y, {C.LABEL} AS label, p, q,
    CAST('0x' || substr(md5(bene_id || {q(f'|{CFG.seed}|')} || CAST(r // 4 AS VARCHAR)), 8 * (r % 4) + 1, 8) AS BIGINT) AS draw
  FROM scored, (SELECT unnest(range(0, 200)) AS r) AS n WHERE sample = {q(OOT)}) AS d WHERE draw >= {POISSON_CUTS[0]}"""
_ci = lambda cols, src: " UNION ALL ".join(
    f"SELECT '{c}' AS metric, quantile_cont({c}, 0.025) AS lower, quantile_cont({c}, 0.975) AS upper FROM {src}" for c in cols)
VIEWS["boot"] = """
WITH m AS (SELECT grp, SUM(w * y) / SUM(w) AS my, SUM(w * y) / SUM(w * p) AS f FROM replicates GROUP BY grp)
SELECT r.grp, SUM(w * p) / SUM(w * y) AS predictive_ratio,
  1 - SUM(w * (y - p) * (y - p)) / SUM(w * (y - my) * (y - my)) AS r2, 1 - SUM(w * abs(y - p)) / SUM(w * abs(y - my)) AS cpm,
  1 - SUM(w * (y - p * f) * (y - p * f)) / SUM(w * (y - my) * (y - my)) AS r2_norm,
  1 - SUM(w * abs(y - p * f)) / SUM(w * abs(y - my)) AS cpm_norm
FROM replicates AS r JOIN m ON m.grp = r.grp GROUP BY r.grp"""
VIEWS["weekly"] = ("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, value, CAST(hour(ts) AS DOUBLE) AS hour, event_type, "
                   "CAST(event_type = 'purchase' AS INT) AS bought FROM events")


def _weeks(column: str) -> str:
    first = (f"SELECT p.period AS grp, e.{column} AS v FROM weekly AS e, (SELECT DISTINCT period FROM weekly) AS p "
             "WHERE e.period = (SELECT MIN(period) FROM weekly)")
    return f"SELECT grp AS period, SUM(psi_contrib) AS v FROM ({psi_sql(first, f'SELECT period AS grp, {column} AS v FROM weekly')}) AS b GROUP BY 1"


VIEWS["week_psi"] = _weeks("value")
VIEWS["week_csi"] = _weeks("hour")
VIEWS["week_auc"] = f"SELECT grp AS period, auc AS v FROM ({auc_sql('SELECT period AS grp, bought AS y, value AS p FROM weekly')}) AS a"
VIEWS["week_means"] = "SELECT period, AVG(value) AS v FROM weekly GROUP BY 1"
VIEWS["week_segments"] = """
SELECT period, arg_max(r, (abs(r - 1), event_type)) AS v FROM (
  SELECT s.period, s.event_type, s.m / b.m AS r FROM (SELECT period, event_type, AVG(value) AS m, COUNT(*) AS n FROM weekly GROUP BY ALL) AS s
  JOIN (SELECT event_type, AVG(value) AS m FROM weekly WHERE period = (SELECT MIN(period) FROM weekly) GROUP BY ALL) AS b
    ON b.event_type = s.event_type WHERE s.n >= 100) AS x GROUP BY 1"""
VIEWS["week_values"] = """
SELECT w.period, w.n, x.metric, x.value FROM (SELECT period, COUNT(*) AS n FROM weekly GROUP BY 1) AS w LEFT JOIN (
  SELECT period, 'psi' AS metric, v AS value FROM week_psi UNION ALL SELECT period, 'csi', v FROM week_csi
  UNION ALL SELECT period, 'ratio', v / (SELECT arg_min(v, period) FROM week_means) FROM week_means
  UNION ALL SELECT m.period, 'segment_ratio', s.v FROM week_means AS m LEFT JOIN week_segments AS s ON s.period = m.period
  UNION ALL SELECT m.period, 'auc', a.v FROM week_means AS m LEFT JOIN week_auc AS a ON a.period = m.period) AS x ON x.period = w.period"""

VIEWS["explained"] = f"""
SELECT *, row_number() OVER (ORDER BY bene_id) AS i FROM (
  SELECT bene_id, {C.TARGET} AS y, paid_total FROM labelled WHERE sample = {q(C.TEST)}
  ORDER BY {hash_number(f"bene_id || {q(f'|{CFG.seed}')}")}, bene_id LIMIT 6000) AS s"""
_m0 = lambda x: f"greatest({x} * trend, floor_)"
_donors = " UNION ALL ".join(
    f"SELECT {r} AS r, paid_total AS given, row_number() OVER (ORDER BY {hash_number(f'bene_id || {q(f'|{CFG.seed}|{r}')}')}, bene_id) AS i "
    "FROM explained" for r in range(3))
VIEWS["shuffled"] = f"""
SELECT AVG(mae) - MAX(plain) AS importance, stddev_pop(mae) AS std FROM (
  SELECT r, AVG(abs(y - {_m0('given')})) AS mae, AVG(abs(y - {_m0('paid_total')})) AS plain
  FROM explained AS e JOIN ({_donors}) AS d ON d.i = e.i, m0 GROUP BY r) AS x"""

_corr = ", ".join(f"corr({f}, {C.TARGET})" for f in C.FEATURES)
VIEWS["corrs"] = (
    f"SELECT feature, CASE WHEN isnan(c) THEN NULL ELSE c END AS corr FROM (SELECT unnest(fs) AS feature, unnest(cs) AS c FROM ("
    f"SELECT [{', '.join(q(f) for f in C.FEATURES)}] AS fs, [{_corr}] AS cs FROM msampled WHERE sample = {q(C.TRAIN)}) AS w) AS u")

_shocks = {"Prior-year costs -10%": -0.10, "Prior-year costs +10%": 0.10, "Prior-year costs +25%": 0.25,
           # persistence does not look at these two
           "n_chronic +1 for all members": 0.0, "ip_admits +1 for all members": 0.0}
_lines = "SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey"

_CELL_ROWS = (f"SELECT CAST(m.is_female AS BIGINT) AS is_female, m.{C.TARGET} AS y, l.{C.LABEL} AS label FROM msampled AS m JOIN labelled AS l "
              f"ON l.bene_id = m.bene_id AND l.year = m.year WHERE m.sample = {q(C.TRAIN)}")
_steps = lambda src: (
    "SELECT is_female, n, sy, sl, f + 0.5 * (sy - n * exp(f)) / (n * exp(f) + 1) AS f, "
    "g + 0.5 * (sl - n / (1 + exp(-g))) / (n / (1 + exp(-g)) * (1 - 1 / (1 + exp(-g))) + 1) AS g FROM (" + src + ") AS t")

BODIES: dict[str, str] = {
    "scan_counts": " UNION ALL ".join(
        [f"SELECT 'bene_{y}' AS source, COUNT(*) AS n_rows FROM stg_bene WHERE FILE_YEAR = {y}" for y in CFG.years]
        + ["SELECT 'inpatient', COUNT(*) FROM stg_ip", "SELECT 'outpatient', COUNT(*) FROM stg_op"]),
    "csv_round_trip": " UNION ALL ".join(
        f"SELECT {q(name)} AS source, TRUE AS found, COUNT(*) AS n_rows, COUNT(DISTINCT {C.ID}) AS n_members, "
        f"SUM(CAST({gap} IS NULL OR {gap} = '' AS INT)) AS n_gaps FROM {table}"
        for name, gap, table in [*((f"bene_{y}", "BENE_DEATH_DT", f"stg_bene WHERE FILE_YEAR = {y}") for y in CFG.years),
                                 ("inpatient", "CLM_ADMSN_DT", "stg_ip"), ("outpatient", "CLM_FROM_DT", "stg_op")])
        + " UNION ALL SELECT 'carrier', FALSE, NULL, NULL, NULL",
    "evidence_round_trip": "SELECT *, TRUE AS generated_data, 'GENERATED TEST SAMPLE - NOT REAL CLAIMS' AS data_source FROM dq_all",
    "stack_years": f"SELECT FILE_YEAR AS year, COUNT(*) AS n_rows, COUNT(DISTINCT {C.ID}) AS n_members FROM stg_bene GROUP BY 1",
    "lenient_cast": f"SELECT CLM_ID AS claim_id, SEGMENT AS segment, {lint('CLM_UTLZTN_DAY_CNT')} AS days_zero, "
                    f"{lint('CLM_UTLZTN_DAY_CNT', 'NULL')} AS days_null, {lint('ICD9_DGNS_CD_1')} AS code_zero, "
                    f"{lint('ICD9_DGNS_CD_1', 'NULL')} AS code_null, {lreal('CLM_PMT_AMT')} AS amount FROM stg_ip",
    "yyyymmdd_parse": f"SELECT CLM_ID AS claim_id, SEGMENT AS segment, "
                      f"{day("COALESCE(NULLIF(CLM_ADMSN_DT, ''), CLM_FROM_DT)")} AS admit, {day('CLM_THRU_DT')} AS thru FROM stg_ip",
    "member_year": "SELECT * FROM member_year",
    "condition_flags": "SELECT * FROM member_year",
    "stays": "SELECT * FROM ip_stay",
    "readmissions": "SELECT * FROM ip_readmit",
    "stay_util": "SELECT * FROM ip_util",
    "visits": "SELECT * FROM op_util",
    "provider_count": "SELECT * FROM prov_util",
    "dx_long": "SELECT * FROM dx_rows",
    "code_groups": "SELECT * FROM dx_flags",
    "next_year_join": "SELECT * FROM outcome",
    "model_base": "SELECT * FROM base_rows",
    "population_waterfall": "SELECT * FROM waterfall ORDER BY feature_year, step",
    "waterfall_pivot": "SELECT step, rule, " + ", ".join(
        f"SUM(CASE WHEN feature_year = {y} THEN n END) AS n_{y}" for y in (CFG.dev_year, CFG.oot_year))
                       + " FROM waterfall GROUP BY step, rule",
    "model_dataset": f"SELECT * FROM base_rows WHERE {ELIGIBLE}",
    "floor_target": "SELECT *, (SELECT SUM(CAST(target_paid_raw < 0 AS INT)) FROM people) AS n_negative FROM people",
    "feature_matrix": "SELECT * FROM matrix",
    "bands": f"SELECT bene_id, year, {BANDS} FROM member_year",
    "dq_volume": "SELECT FILE_YEAR AS year, COUNT(*) AS n_rows FROM stg_bene GROUP BY 1",
    "dq_duplicates": "SELECT * FROM dq_dups",
    "dq_shares": "SELECT * FROM dq_share_rows",
    "dq_date_order": f"SELECT year(o_orderdate) AS year, COUNT(*) AS n_dated, SUM(CAST(l_shipdate < o_orderdate AS INT)) AS n_early, "
                     f"AVG(CAST(l_shipdate < o_orderdate AS INT)) AS share FROM ({_lines}) AS l GROUP BY 1",
    "dq_orphans": "SELECT * FROM dq_orphan",
    "dq_after_death": "SELECT * FROM dq_death",
    "reconciliation": "SELECT * FROM recon",
    "yoy_trend": "SELECT * FROM trend",
    "dq_suite": "SELECT * FROM dq_all",
    "hash_split": f"SELECT bene_id, CAST(CAST({hash_number(f'bene_id || {q(f'|{CFG.seed}')}')} AS DOUBLE) / 4294967296.0 "
                  f"< {CFG.test_share} AS INT) AS is_test FROM member_year WHERE year = {CFG.dev_year}",
    "hash_sample": f"SELECT * FROM people ORDER BY {hash_number(f'bene_id || {q('|')} || CAST(year AS VARCHAR) || {q(f'|{CFG.seed}')}')}, "
                   "bene_id, year LIMIT 500",
    "model_split": f"SELECT sample, COUNT(*) AS n, SUM({C.LABEL}) AS n_high_cost, MAX(threshold) AS threshold "
                   "FROM labelled, cutoff GROUP BY sample",
    "quantiles": " UNION ALL ".join(
        f"SELECT year, {p} AS prob, quantile_cont(paid_total, {p}) AS quantile FROM member_year GROUP BY year"
        for p in (0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0)),
    "global_rank": "SELECT *, row_number() OVER (ORDER BY paid_total NULLS FIRST, bene_id, year) AS rank FROM member_year",
    "risk_deciles": f"SELECT id AS bene_id, p, bin AS risk_decile FROM ({binned_sql(only(SCORED_P, OOT))}) AS b",
    "naive_persistence": "SELECT bene_id, year, p AS prediction FROM scored",
    "demographic_rate": with_rate("labelled", "cost_rates", "prediction"),
    "rating_cells": "SELECT * FROM cost_rates",
    "reg_metrics": f"SELECT grp AS sample, * FROM ({reg_sql(SCORED_P)}) AS m",
    "gini_norm": f"SELECT grp AS sample, gini FROM ({reg_sql(SCORED_P)}) AS m",
    "normalise": f"SELECT sample, f AS norm_factor, SUM(p * f) AS total_normalised, SUM({C.TARGET}) AS total_actual FROM (SELECT *, "
                 f"SUM({C.TARGET}) OVER (PARTITION BY sample) / SUM(p) OVER (PARTITION BY sample) AS f FROM scored) AS s GROUP BY sample, f",
    "decile_table": f"SELECT grp AS sample, bin AS decile, COUNT(*) AS n, SUM(p) AS pred_sum, SUM(y) AS actual_sum, AVG(p) AS mean_pred, "
                    f"AVG(y) AS mean_actual, SUM(p) / SUM(y) AS predictive_ratio FROM ({binned_sql(SCORED_P)}) AS b GROUP BY grp, bin",
    "auc": f"SELECT grp AS sample, * FROM ({auc_sql(SCORED_Q)}) AS m",
    "ks": f"SELECT grp AS sample, * FROM ({auc_sql(SCORED_Q)}) AS m",
    "roc_curve": f"""WITH c AS (SELECT p, SUM({C.LABEL}) AS pos, SUM(1 - {C.LABEL}) AS neg FROM scored WHERE sample = {q(OOT)} GROUP BY p),
r AS (SELECT row_number() OVER (ORDER BY p DESC) AS position, SUM(neg) OVER (ORDER BY p DESC) / SUM(neg) OVER () AS fpr,
        SUM(pos) OVER (ORDER BY p DESC) / SUM(pos) OVER () AS tpr, COUNT(*) OVER () AS d FROM c),
g AS (SELECT DISTINCT (i * d) // 199 AS position FROM (SELECT unnest(range(0, 200)) AS i) AS k, (SELECT COUNT(*) AS d FROM c) AS n)
SELECT position, fpr, tpr FROM r WHERE d <= 199 OR position IN (SELECT position FROM g) UNION ALL SELECT 0, 0.0, 0.0""",
    "clf_metrics": f"SELECT grp AS sample, * FROM ({clf_sql(SCORED_Q)}) AS m",
    "hosmer_lemeshow": f"SELECT grp AS sample, * FROM ({hl_sql(SCORED_Q)}) AS m",
    "calibration_table": f"SELECT grp AS sample, bin, AVG(p) AS mean_pred, AVG(y) AS obs_rate, COUNT(*) AS n "
                         f"FROM ({binned_sql(SCORED_Q)}) AS b GROUP BY grp, bin",
    "relative_top_label": "SELECT grp AS sample, * FROM (" + clf_sql(
        f"{SCORED_Q} UNION ALL SELECT {q(C.RELATIVE)}, bene_id, CAST({C.TARGET} >= cut AS INT), q FROM scored, "
        f"(SELECT quantile_cont({C.TARGET}, {CFG.high_cost_quantile}) AS cut FROM scored WHERE sample = {q(OOT)}) AS k "
        f"WHERE sample = {q(OOT)}") + ") AS m",
    "psi_score": "SELECT *, SUM(psi_contrib) OVER () AS psi, CASE WHEN SUM(psi_contrib) OVER () < 0.1 THEN 'Stable' "
                 "WHEN SUM(psi_contrib) OVER () < 0.25 THEN 'Monitor' ELSE 'Significant shift' END AS verdict FROM score_psi",
    "csi": "SELECT * FROM feature_csi",
    "csi_top": "SELECT * FROM feature_csi ORDER BY round(csi, 6) DESC, feature LIMIT 15",
    "feature_target_corr": "SELECT * FROM corrs",
    "leakage_review": "SELECT '' AS forbidden_features, arg_max(feature, abs(corr)) AS max_abs_corr_feature, "
                      "MAX(abs(corr)) AS max_abs_corr FROM corrs",
    "segment_calibration": "SELECT * FROM segs",
    **{name: f"SELECT *, CASE WHEN n >= {least} AND (pred_mean / actual_mean < 0.85 OR pred_mean / actual_mean > 1.15) "
             "THEN 'BREACH' ELSE 'OK' END AS status FROM segs" for name, least in (("segment_breaches", 50), ("segment_breaches_small", 50))},
    "fairness": "SELECT * FROM fair",
    "ratio_crosstab": "SELECT age_band, " + ", ".join(
        f"SUM(CASE WHEN sex = '{s}' THEN p END) / SUM(CASE WHEN sex = '{s}' THEN {C.TARGET} END) * MAX(k.f) AS {s.lower()}_ratio"
        for s in ("Female", "Male")) + f", SUM(p) / SUM({C.TARGET}) * MAX(k.f) AS all_ratio, COUNT(*) AS n, AVG({C.TARGET}) AS actual_mean "
        f"FROM banded, (SELECT SUM({C.TARGET}) / SUM(p) AS f FROM banded) AS k GROUP BY age_band",
    "monotonicity": "SELECT *, (SELECT COALESCE(MIN(step) > -0.02 * AVG(mean_pred), TRUE) FROM mono) AS monotonic FROM mono",
    "input_shock": " UNION ALL ".join(
        f"SELECT {q(name)} AS test, AVG(greatest(paid_total * (1 + {s}) * trend, floor_)) / AVG(greatest(paid_total * trend, floor_)) - 1 "
        f"AS mean_pred_change FROM msampled, m0 WHERE sample = {q(OOT)}" for name, s in _shocks.items()),
    "scored_members": "SELECT * FROM roster",
    "decile_backtest": "SELECT * FROM backtest",
    "decile_capture": "SELECT * FROM backtest WHERE risk_decile > 0",
    "summary_kpis": "SELECT COUNT(*) AS members, SUM(predicted_cost) AS predicted, SUM(actual_cost) AS actual, "
                    "SUM(predicted_cost) / SUM(actual_cost) AS predictive_ratio, SUM(actual_cost) / SUM(predicted_cost) AS norm_factor, "
                    "pow(corr(actual_cost, predicted_cost), 2) AS rsq FROM roster",
    "findings_rating": f"""WITH s AS (SELECT COUNT(*) FILTER (severity = 'High') AS n_high, COUNT(*) FILTER (severity = 'Medium') AS n_medium,
  COUNT(*) FILTER (severity = 'Low') AS n_low FROM found)
SELECT printf('F-%02d', row_number() OVER (ORDER BY rule_, order_)) AS id, area, severity, finding, evidence, s.*,
  CASE WHEN n_high >= 2 THEN {q(findings.RATINGS[0])} WHEN n_high = 1 THEN {q(findings.RATINGS[1])}
       WHEN n_medium > 0 THEN {q(findings.RATINGS[2])} ELSE {q(findings.RATINGS[3])} END AS rating FROM found, s""",
    "workbook_kpis": f"""SELECT k.*, s.n_high, s.n_medium, s.n_low,
  CASE WHEN n_high >= 2 THEN {q(findings.RATINGS[0])} WHEN n_high = 1 THEN {q(findings.RATINGS[1])}
       WHEN n_medium > 0 THEN {q(findings.RATINGS[2])} ELSE {q(findings.RATINGS[3])} END AS rating, c.*
FROM (SELECT COUNT(*) AS members, SUM(predicted_cost) AS predicted, SUM(actual_cost) AS actual, SUM(predicted_cost) / SUM(actual_cost) AS predictive_ratio,
        SUM(actual_cost) / SUM(predicted_cost) AS norm_factor, pow(corr(actual_cost, predicted_cost), 2) AS rsq FROM roster) AS k,
  (SELECT COUNT(*) FILTER (severity = 'High') AS n_high, COUNT(*) FILTER (severity = 'Medium') AS n_medium,
     COUNT(*) FILTER (severity = 'Low') AS n_low FROM found) AS s,
  (SELECT COUNT(*) AS checks, COUNT(*) FILTER (status = 'FAIL') AS checks_failed, COUNT(*) FILTER (status = 'WARN') AS checks_warned,
     MAX(CASE WHEN check_id = 'DQ-18' THEN observed END) AS paid_move FROM dq_all) AS c""",
    "monitoring_status": """SELECT period, n, metric, value, CASE WHEN value IS NULL THEN NULL
  WHEN metric IN ('psi', 'csi') THEN CASE WHEN value < 0.1 THEN 'Green' WHEN value <= 0.25 THEN 'Amber' ELSE 'Red' END
  WHEN metric = 'ratio' THEN CASE WHEN value BETWEEN 0.95 AND 1.05 THEN 'Green' WHEN value BETWEEN 0.90 AND 1.10 THEN 'Amber' ELSE 'Red' END
  WHEN metric = 'segment_ratio' THEN CASE WHEN value BETWEEN 0.90 AND 1.10 THEN 'Green' WHEN value BETWEEN 0.85 AND 1.15 THEN 'Amber' ELSE 'Red' END
  ELSE CASE WHEN value >= base - 0.02 THEN 'Green' WHEN value >= base - 0.05 THEN 'Amber' ELSE 'Red' END END AS status
FROM week_values, (SELECT arg_min(v, period) AS base FROM week_auc) AS f""",
    "benchmark_comparison": "SELECT split_part(grp, '|', 1) AS model, split_part(grp, '|', 2) AS sample, * FROM ("
                            + reg_sql("SELECT * FROM duel_rows") + ") AS m",
    # persistence looks at one input only: shuffling the others changes nothing
    "importance_of_persistence": "SELECT 'paid_total' AS feature, importance, std FROM shuffled UNION ALL "
                                 "SELECT unnest(['paid_ip', 'benres_total']), 0.0, 0.0",
    "dependence_of_persistence": f"""SELECT 'paid_total' AS feature, v AS value, AVG({_m0('v')}) AS avg_pred FROM explained, m0, (
  SELECT DISTINCT CASE WHEN k >= 20 THEN low + (high - low) * step / 19 ELSE u END AS v FROM (
    SELECT COUNT(DISTINCT paid_total) AS k, quantile_cont(paid_total, 0.05) AS low, quantile_cont(paid_total, 0.95) AS high,
      list(DISTINCT paid_total) AS us FROM explained) AS q, unnest(range(0, 20)) AS g(step), unnest(us) AS w(u)) AS grid GROUP BY v""",
    "bootstrap_ci": _ci(("r2", "cpm", "predictive_ratio", "r2_norm", "cpm_norm"), "boot"),
    # replicates that drew one class only have no AUC
    "bootstrap_auc": _ci(("auc",), f"({auc_sql('SELECT grp, label AS y, q AS p, w FROM replicates', 'w')}) AS b "
                                   "WHERE n_pos > 0 AND n_neg > 0"),
    "bootstrap_auc_relative": _ci(("auc_relative",), "(SELECT auc AS auc_relative FROM (" + auc_sql(
        f"SELECT grp, CAST(y >= cut AS INT) AS y, q AS p, w FROM replicates, (SELECT quantile_cont({C.TARGET}, {CFG.high_cost_quantile}) AS cut "
        f"FROM scored WHERE sample = {q(OOT)}) AS k", "w") + ") AS b WHERE n_pos > 0 AND n_neg > 0) AS r"),
    "benchmark_robustness": 'SELECT grp AS test, kind AS "group", r2 AS r2_norm, cpm AS cpm_norm, gini, raw AS raw_predictive_ratio FROM bench_metrics',
    "saturated_fits": f"SELECT is_female, AVG(y) AS cost, AVG(label) AS chance FROM ({_CELL_ROWS}) AS c GROUP BY is_female",
    # start at the mean, then three Newton steps of rate 1/2 with a ridge of 1 in each cell
    "boosting_steps": "SELECT is_female, exp(f) AS cost, 1 / (1 + exp(-g)) AS chance FROM (" + _steps(_steps(_steps(
        f"SELECT is_female, COUNT(*) AS n, SUM(y) AS sy, SUM(label) AS sl, ln(MAX(my)) AS f, ln(MAX(ml) / (1 - MAX(ml))) AS g FROM ({_CELL_ROWS}) AS c, "
        f"(SELECT AVG(y) AS my, AVG(label) AS ml FROM ({_CELL_ROWS}) AS d) AS m GROUP BY is_female"))) + ") AS s",
}


def _needed(text: str, done: list[str]) -> list[str]:
    """View names a text depends on, each after the views it needs itself."""
    for name in VIEWS:
        if name not in done and re.search(rf"\b{name}\b", text):
            _needed(VIEWS[name], done)
            if name not in done:
                done.append(name)
    return done


def with_views(body: str) -> str:
    names = _needed(body, [])
    if not names:
        return body
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in names)
    return f"WITH {ctes}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {name: with_views(finish_sql(name, body)) for name, body in BODIES.items()}
