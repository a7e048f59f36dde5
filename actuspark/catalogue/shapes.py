"""Output columns of every registered query: one text per query, shared by the Spark and the SQL side.

``name:i`` is a bigint, ``name:s`` a text, ``name:b`` a boolean, ``name:N`` a double rounded to N decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from actuspark import config as C

_FLAGS = " ".join(f"{c}:i" for c in C.CHRONIC_FEATURES)
_DX = " ".join(f"{c}:i" for c in C.DX_FEATURES)
_MEMBER = (
    "bene_id:s year:i age:i is_female:i race_cd:i esrd:i state_cd:i death_dt:i part_a_mos:i part_b_mos:i hmo_mos:i "
    f"part_d_mos:i {_FLAGS} n_chronic:i paid_ip:2 paid_op:2 paid_car:2 paid_total:2 benres_total:2 pppymt_total:2")
_OUTCOME = "target_year:i target_paid:2 target_paid_ip:2 target_part_a_mos:i target_part_b_mos:i target_death_dt:i"
_BASE = (
    f"{_MEMBER} ip_admits:i ip_days:i ip_readmit_30d:i op_visits:i er_visits:i n_providers:i n_distinct_dx:i {_DX} "
    f"{_OUTCOME} elig_in_next_year:i elig_alive_end_of_base:i elig_base_coverage:i elig_next_coverage:i")
_REG = "n:i r2:6 cpm:6 mae:4 rmse:4 predictive_ratio:6 gini:6 top_capture:6 mean_actual:4 mean_predicted:4"
_CLF = ("n:i auc:6 gini:6 ks:6 brier:6 precision_top:6 recall_top:6 lift_top:6 hl_stat:6 hl_pvalue:6 event_rate:6 "
        "mean_probability:6")
_DECILE = "n:i pred_sum:2 actual_sum:2 mean_pred:4 mean_actual:4 predictive_ratio:6"
_CHECK = "check_id:s observed:4 threshold:4 rule:s status:s"
_SEGMENT = "dimension:s level:s n:i actual_mean:4 pred_mean:4 predictive_ratio:6"

SHAPES: dict[str, str] = {
    "scan_counts": "source:s n_rows:i",
    "stack_years": "year:i n_rows:i n_members:i",
    "lenient_cast": "claim_id:s segment:s days_zero:i days_null:i code_zero:i code_null:i amount:2",
    "yyyymmdd_parse": "claim_id:s segment:s admit:s thru:s",
    "member_year": _MEMBER,
    "condition_flags": f"bene_id:s year:i {_FLAGS} n_chronic:i",
    "stays": "bene_id:s claim_id:s year:i admit_date:s discharge_date:s util_days:i provider:s",
    "readmissions": "bene_id:s year:i ip_readmit_30d:i",
    "stay_util": "bene_id:s year:i ip_admits:i ip_days:i",
    "visits": "bene_id:s year:i op_visits:i er_visits:i",
    "provider_count": "bene_id:s year:i n_providers:i",
    "dx_long": "bene_id:s year:i dx:s",
    "code_groups": f"bene_id:s year:i n_distinct_dx:i {_DX}",
    "next_year_join": f"bene_id:s year:i paid_total:2 {_OUTCOME}",
    "model_base": _BASE,
    "population_waterfall": "feature_year:i step:i rule:s n:i",
    "waterfall_pivot": "step:i rule:s n_1999:i n_2000:i",
    "model_dataset": _BASE,
    "floor_target": "bene_id:s year:i target_paid_raw:2 target_paid:2 " + " ".join(f"{c}:2" for c in C.COST_FEATURES)
                    + " n_negative:i",
    "feature_matrix": "bene_id:s year:i target_paid:2 " + " ".join(f"{c}:6" for c in C.FEATURES),
    "bands": "bene_id:s year:i age_band:s sex:s race:s esrd_status:s chronic_band:s prior_cost_band:s",
    "dq_volume": "year:i n_rows:i",
    "dq_duplicates": "check_id:s n_duplicates:i",
    "dq_shares": "check_id:s observed:6",
    "dq_date_order": "year:i n_dated:i n_early:i share:6",
    "dq_orphans": "n_claimants:i n_orphans:i share:6",
    "dq_after_death": "n_claims:i n_late:i share:6",
    "reconciliation": "year:i summary_ip:2 claims_ip:2 ratio_claims_to_summary:6 mean_paid:4 yoy_change:6",
    "yoy_trend": "year:i mean_paid:4 yoy_change:6",
    "dq_suite": _CHECK,
    "evidence_round_trip": f"{_CHECK} generated_data:b data_source:s",
    "hash_split": "bene_id:s is_test:i",
    "hash_sample": "bene_id:s year:i target_paid:2",
    "model_split": "sample:s n:i n_high_cost:i threshold:4",
    "quantiles": "year:i prob:2 quantile:4",
    "global_rank": "bene_id:s year:i paid_total:2 rank:i",
    "risk_deciles": "bene_id:s p:2 risk_decile:i",
    "naive_persistence": "bene_id:s year:i prediction:4",
    "demographic_rate": "bene_id:s year:i prediction:4",
    "rating_cells": "age_cell:s sex_cell:i esrd_cell:i cell_mean:4 n:i rate:4",
    "reg_metrics": f"sample:s {_REG}",
    "gini_norm": "sample:s gini:6",
    "normalise": "sample:s norm_factor:6 total_normalised:2 total_actual:2",
    "decile_table": f"sample:s decile:i {_DECILE}",
    "auc": "sample:s auc:6 n_pos:i n_neg:i",
    "ks": "sample:s ks:6",
    "roc_curve": "position:i fpr:6 tpr:6",
    "clf_metrics": f"sample:s {_CLF}",
    "hosmer_lemeshow": "sample:s hl_stat:6 hl_pvalue:6",
    "calibration_table": "sample:s bin:i mean_pred:6 obs_rate:6 n:i",
    "relative_top_label": f"sample:s {_CLF}",
    "psi_score": "bin:i lower:4 upper:4 expected_pct:6 actual_pct:6 psi_contrib:6 psi:6 verdict:s",
    "csi": "feature:s csi:6 n_bins:i",
    "csi_top": "feature:s csi:6",
    "feature_target_corr": "feature:s corr:6",
    "leakage_review": "forbidden_features:s max_abs_corr_feature:s max_abs_corr:6",
    "segment_calibration": _SEGMENT,
    "segment_breaches": f"{_SEGMENT} status:s",
    "csv_round_trip": "source:s found:b n_rows:i n_members:i n_gaps:i",
    "workbook_kpis": "members:i predicted:2 actual:2 predictive_ratio:6 norm_factor:6 rsq:6 n_high:i n_medium:i n_low:i rating:s checks:i "
                     "checks_failed:i checks_warned:i paid_move:6",
    "segment_breaches_small": f"{_SEGMENT} status:s",
    "fairness": "dimension:s level:s n:i event_rate:6 auc:6 flag_rate_top:6 tpr_top:6",
    "ratio_crosstab": "age_band:s female_ratio:6 male_ratio:6 all_ratio:6 n:i actual_mean:4",
    "monotonicity": "level:i mean_pred:4 step:4 monotonic:b",
    "input_shock": "test:s mean_pred_change:6",
    "scored_members": "bene_id:s age_band:s sex:s race:s esrd:s n_chronic:i prior_year_paid:2 predicted_cost:2 "
                      "actual_cost:2 hcc_probability:4 hcc_actual:i risk_decile:i",
    "decile_backtest": "risk_decile:i members:i predicted:2 actual:2 mean_predicted:4 mean_actual:4 "
                       "predictive_ratio:6 cumulative_cost_share:6 hcc_rate:6 normalised_ratio:6",
    "decile_capture": "risk_decile:i actual:2 cumulative_cost_share:6",
    "summary_kpis": "members:i predicted:2 actual:2 predictive_ratio:6 norm_factor:6 rsq:6",
    "findings_rating": "id:s area:s severity:s finding:s evidence:s n_high:i n_medium:i n_low:i rating:s",
    "monitoring_status": "period:s n:i metric:s value:6 status:s",
    "bootstrap_ci": "metric:s lower:6 upper:6",
    "bootstrap_auc": "metric:s lower:6 upper:6",
    "bootstrap_auc_relative": "metric:s lower:6 upper:6",
    "tweedie_glm": f"sample:s {_REG}",
    "boosting_steps": "is_female:i cost:4 chance:6",
    "saturated_fits": "is_female:i cost:4 chance:6",
    "classifier_comparison": f"model:s sample:s {_CLF}",
    "benchmark_robustness": "test:s group:s r2_norm:6 cpm_norm:6 gini:6 raw_predictive_ratio:6",
    "poisson_gbt": f"sample:s {_REG}",
    "logit_clf": f"sample:s {_CLF}",
    "gbt_clf": f"sample:s {_CLF}",
    "model_comparison": f"model:s sample:s {_REG}",
    "benchmark_comparison": f"model:s sample:s {_REG}",
    "importance_of_persistence": "feature:s importance:4 std:4",
    "dependence_of_persistence": "feature:s value:4 avg_pred:4",
    "permutation_importance": "feature:s importance:4 std:4",
    "partial_dependence": "feature:s value:4 avg_pred:4",
    "sensitivity": "test:s mean_pred_change:6",
    "robustness": "test:s group:s r2_norm:6 cpm_norm:6 gini:6 raw_predictive_ratio:6",
    "seed_spread": "r2_std:6",
}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
_SQL = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in SHAPES[name].split()]


def finish(name: str, df: DataFrame) -> DataFrame:
    """Project a result to its declared columns."""
    out = []
    for c, kind in _columns(name):
        value = (f"CAST(`{c}` AS {_SPARK[kind]})" if kind in _SPARK
                 else f"round(CAST(`{c}` AS double), {kind}) + CAST(0.0 AS double)")
        out.append(f"{value} AS `{c}`")
    return df.selectExpr(out)


def finish_sql(name: str, body: str) -> str:
    """The same projection around a SQL text."""
    out = []
    for c, kind in _columns(name):
        value = f'CAST("{c}" AS {_SQL[kind]})' if kind in _SQL else f'ROUND(CAST("{c}" AS DOUBLE), {kind}) + 0.0'
        out.append(f'{value} AS "{c}"')
    return f"SELECT {', '.join(out)} FROM ({body}) AS result"
