"""Full validation of fitted models: every evidence table, findings and rating."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.functions.columns import correlation, divide, labelled
from actuspark.ml.baselines import CredibilityRate, Resampled, age_sex_esrd
from actuspark.ml.boosting import BoostedCost
from actuspark.ml.registry import BoostingBudget, class_estimators, cost_estimators, fit_all, score_all
from actuspark.operators import bootstrap, classification, explain, quality, regression, segments, stability
from actuspark.operators.ranking import attach, equal_frequency_bins, quantile_value
from actuspark.operators.shaping import columns_starting, pivot_periods
from actuspark.plans import claims
from actuspark.plans import findings as rules
from actuspark.session import materialize
from actuspark.sources.readers import RawTables

KEY = "bene_id"
BY = ["model", "sample"]


def with_normalised(scored: DataFrame, oot_sample: str, y: str = C.TARGET) -> DataFrame:
    """Add the out-of-time rows once more, rescaled per model to the actual total."""
    oot = scored.filter(F.col("sample") == oot_sample)
    factors = oot.groupBy("model").agg(divide(F.sum(y), F.sum("prediction")).alias("_factor"))
    again = attach(oot, factors, ["model"]).select(
        *[F.lit(C.NORMALISED).alias("sample") if c == "sample"
          else (F.col("prediction") * F.col("_factor")).alias("prediction") if c == "prediction"
          else F.col(c) for c in scored.columns])
    return scored.unionByName(again)


def with_relative_label(scored: DataFrame, oot_sample: str, quantile: float, y: str = C.TARGET,
                        label: str = C.LABEL) -> DataFrame:
    """Add the out-of-time rows once more, labelled by the top share of their own outcomes."""
    oot = scored.filter(F.col("sample") == oot_sample)
    one_model = oot.filter(F.col("model") == oot.select("model").first()[0])
    cut = quantile_value(one_model, y, quantile)
    again = oot.withColumn(label, (F.col(y) >= F.lit(cut)).cast("int")).withColumn("sample", F.lit(C.RELATIVE))
    return scored.unionByName(again)


def cost_comparison(scored: DataFrame) -> DataFrame:
    """Regression metrics of every model on every sample, in one grouped computation."""
    return regression.regression_metrics(scored, C.TARGET, "prediction", KEY, BY)


def class_comparison(scored: DataFrame) -> DataFrame:
    return classification.classification_metrics(scored, C.LABEL, "prediction", KEY, BY)


def forbidden_features(features: tuple[str, ...]) -> list[str]:
    """Inputs a model must not have: outcomes, race, state."""
    return columns_starting(features, ("target",), ("race_cd", "state_cd"))


def leakage_review(train: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Forbidden inputs and the feature most correlated with the outcome, on one row."""
    corr = regression.feature_target_correlation(train, features, C.TARGET)
    return corr.agg(
        F.lit(",".join(forbidden_features(features))).alias("forbidden_features"),
        F.max_by("feature", F.abs("corr")).alias("max_abs_corr_feature"), F.max(F.abs("corr")).alias("max_abs_corr"))


def scored_members(oot: DataFrame, cost: str, probability: str) -> DataFrame:
    """Publishable member table: segments, prediction, outcome, probability and risk decile (of the rounded score)."""
    rows = claims.with_bands(oot).select(
        KEY, "age_band", "sex", "race", F.when(F.col("esrd") == 1, "Y").otherwise("N").alias("esrd"),
        F.col("n_chronic").cast("int").alias("n_chronic"), F.col("paid_total").alias("prior_year_paid"),
        F.round(cost, 2).alias("predicted_cost"), F.col(C.TARGET).alias("actual_cost"),
        F.round(probability, 4).alias("hcc_probability"), F.col(C.LABEL).cast("int").alias("hcc_actual"))
    return equal_frequency_bins(rows, [F.col("predicted_cost"), F.col(KEY)], 10, "risk_decile")


def decile_backtest(members: DataFrame) -> DataFrame:
    """Decile rows and a total row (decile 0) over scored members, with normalised ratio and cumulative cost share."""
    sets = members.groupBy("risk_decile").agg(
        F.count(F.lit(1)).alias("members"), F.sum("predicted_cost").alias("predicted"),
        F.sum("actual_cost").alias("actual"), F.sum("hcc_actual").alias("_hcc"))
    # ten rows from here on, so plain windows will do
    whole = W.partitionBy(F.lit(1))
    up_to = whole.orderBy("risk_decile").rowsBetween(W.unboundedPreceding, 0)
    total = sets.agg(F.sum("members").alias("members"), F.sum("predicted").alias("predicted"),
                     F.sum("actual").alias("actual"), F.sum("_hcc").alias("_hcc"))
    total = total.select(F.lit(0).alias("risk_decile"), *total.columns)
    rows = sets.unionByName(total)
    overall = F.max(F.when(F.col("risk_decile") == 0, F.struct("predicted", "actual"))).over(whole)
    ratio = divide("predicted", "actual")
    running = F.sum(F.when(F.col("risk_decile") > 0, F.col("actual"))).over(up_to)
    return rows.select(
        "risk_decile", "members", "predicted", "actual", (F.col("predicted") / F.col("members")).alias("mean_predicted"),
        (F.col("actual") / F.col("members")).alias("mean_actual"), ratio.alias("predictive_ratio"),
        F.when(F.col("risk_decile") > 0, divide(running, overall["actual"])).alias("cumulative_cost_share"),
        (F.col("_hcc") / F.col("members")).alias("hcc_rate"),
        (ratio * divide(overall["actual"], overall["predicted"])).alias("normalised_ratio"))


def summary_kpis(members: DataFrame) -> DataFrame:
    """Headline numbers of the scored members on one row."""
    return members.agg(
        F.count("predicted_cost").alias("members"), F.sum("predicted_cost").alias("predicted"),
        F.sum("actual_cost").alias("actual"), F.pow(correlation("actual_cost", "predicted_cost"), 2).alias("rsq"),
    ).select("members", "predicted", "actual", divide("predicted", "actual").alias("predictive_ratio"),
             divide("actual", "predicted").alias("norm_factor"), "rsq")


def workbook_kpis(kpis: DataFrame, found: DataFrame, dq: DataFrame) -> DataFrame:
    """The headline numbers with findings by severity, failed and warned checks, and the last yearly move of paid amounts."""
    status = lambda s: F.count(F.when(F.col("status") == s, 1))
    checks = dq.agg(F.count(F.lit(1)).alias("checks"), status("FAIL").alias("checks_failed"), status("WARN").alias("checks_warned"),
                    F.max(F.when(F.col("check_id") == "DQ-18", F.col("observed"))).alias("paid_move"))
    return attach(attach(kpis, rules.rating(found), ()), checks, ())


def fairness_table(oot: DataFrame, probability: str) -> DataFrame:
    # rows of unknown race count for the other dimensions and for the cut; their own level is null and skipped
    named = oot.withColumns({
        "race": labelled("race_cd", C.RACE_LABELS, F.col("race_cd").cast("string")),
        "sex": F.when(F.col("is_female") == 1, "Female").otherwise("Male")})
    return segments.fairness(named, ["race", "sex"], C.LABEL, probability)


@dataclass(frozen=True)
class Refit:
    test: str
    group: str
    estimator: object


def refits(cfg: C.ClaimsConfig, budget: BoostingBudget, seeds: tuple[int, ...] = (1, 2, 3, 4, 5)) -> list[Refit]:
    """Seed, hyper-parameter and feature-group variations of the champion."""
    def make(features=cfg.features, **kw) -> BoostedCost:
        base = dict(max_iter=budget.cost_rounds, learning_rate=budget.cost_rate, min_leaf=budget.min_leaf_cost,
                    seed=cfg.seed)
        return BoostedCost(features, **{**base, **kw})

    without = lambda prefixes, exact=(): tuple(
        f for f in cfg.features if f not in columns_starting(cfg.features, prefixes, exact))
    out = [Refit(f"Seed {s}", "seed", make(seed=s)) for s in seeds]
    out += [
        Refit("learning_rate=0.10", "hyperparameter", make(learning_rate=0.10)),
        Refit("max_leaf_nodes=15", "hyperparameter", make(max_leaves=15)),
        Refit("max_leaf_nodes=63", "hyperparameter", make(max_leaves=63)),
        Refit("loss=squared_error", "hyperparameter", make(loss="squared_error")),
        Refit("Drop prior-cost features", "ablation", make(without(("paid", "benres", "log_paid")))),
        Refit("Drop claims-derived features", "ablation",
              make(without(("ip_", "op_", "er_", "n_providers", "n_distinct", "dx_")))),
        Refit("Drop chronic-condition flags", "ablation", make(without(("sp_",), ("n_chronic",)))),
    ]
    return out


def benchmark_refits(cfg: C.ClaimsConfig, seeds: tuple[int, ...] = (1, 2, 3, 4, 5)) -> list[Refit]:
    """The same kinds of variation for the rate model: rows drawn by seed, credibility constant, rating factors."""
    cells = age_sex_esrd()
    out = [Refit(f"Seed {s}", "seed", Resampled(CredibilityRate(), s)) for s in seeds]
    out += [Refit(f"k={k}", "hyperparameter", CredibilityRate(k=k)) for k in (50, 800)]
    return out + [Refit(f"Drop {name}", "ablation", CredibilityRate(cells={c: v for c, v in cells.items() if c != name})) for name in cells]


def robustness(train: DataFrame, oot: DataFrame, plan: list[Refit]) -> DataFrame:
    """Out-of-time metrics of each refit: R2 and CPM after normalisation, Gini, raw predictive ratio."""
    models = fit_all(train, {r.test: r.estimator for r in plan})
    long = materialize(score_all(oot, models, [KEY, C.TARGET]), "refits")
    raw = long.groupBy("model").agg(divide(F.sum("prediction"), F.sum(C.TARGET)).alias("raw_predictive_ratio"))
    scaled = regression.normalise(long, C.TARGET, "prediction", ["model"])
    metrics = regression.regression_metrics(scaled, C.TARGET, "prediction", KEY, ["model"])
    names = train.sparkSession.createDataFrame([(r.test, r.group) for r in plan], "model string, group string")
    joined = names.join(metrics, "model").join(raw, "model")
    return joined.select(F.col("model").alias("test"), "group", F.col("r2").alias("r2_norm"),
                         F.col("cpm").alias("cpm_norm"), "gini", "raw_predictive_ratio")


@dataclass(frozen=True)
class Models:
    cost: Mapping[str, object]
    classes: Mapping[str, object]


def fit_models(train: DataFrame, cfg: C.ClaimsConfig, budget: BoostingBudget = BoostingBudget()) -> Models:
    cost, classes = cost_estimators(cfg, budget), class_estimators(cfg, budget)
    fitted = fit_all(train, {**cost, **classes})
    return Models({n: fitted[n] for n in cost}, {n: fitted[n] for n in classes})


def validate(parts: claims.Split, models: Models, cfg: C.ClaimsConfig, dq: DataFrame,
             budget: BoostingBudget = BoostingBudget(), champion: str = C.M3, challenger: str = C.M2,
             champion_class: str = C.C2, bootstrap_n: int = 200, with_refits: bool = True) -> dict[str, DataFrame]:
    """All evidence tables of a run, keyed by name."""
    keep = [KEY, "sample", C.TARGET, C.LABEL]
    cost = materialize(with_normalised(score_all(parts.all_rows, models.cost, keep), cfg.oot_sample), "cost")
    classes = materialize(with_relative_label(
        materialize(score_all(parts.all_rows, models.classes, keep), "class"), cfg.oot_sample,
        cfg.high_cost_quantile), "class")
    pick = lambda df, model, sample: df.filter((F.col("model") == model) & (F.col("sample") == sample))
    test, oot = pick(cost, champion, C.TEST), pick(cost, champion, cfg.oot_sample)
    oot_n = pick(cost, champion, C.NORMALISED)
    oot_c, oot_rel = pick(classes, champion_class, cfg.oot_sample), pick(classes, champion_class, C.RELATIVE)
    full = materialize(
        parts.oot.join(oot.select(KEY, F.col("prediction").alias("p")), KEY)
        .join(oot_n.select(KEY, F.col("prediction").alias("p_norm")), KEY)
        .join(oot_c.select(KEY, F.col("prediction").alias("p_class")), KEY), "oot")

    ev: dict[str, DataFrame] = {"leakage": leakage_review(parts.train, cfg.features)}
    ev["reg_comparison"] = materialize(cost_comparison(cost), "evidence")
    ev["clf_comparison"] = materialize(class_comparison(classes), "evidence")
    ev["norm_factor"] = oot.agg(divide(F.sum(C.TARGET), F.sum("prediction")).alias("norm_factor"))
    for name, df in (("decile_test", test), ("decile_oot", oot), ("decile_oot_norm", oot_n)):
        ev[name] = regression.decile_table(df, C.TARGET, "prediction", KEY)
    replicates = bootstrap.bootstrap_regression(oot, C.TARGET, "prediction", KEY, bootstrap_n, cfg.seed)
    intervals = [bootstrap.interval(materialize(replicates, "boot"),
                                    ["r2", "cpm", "predictive_ratio", "r2_norm", "cpm_norm"])]
    for name, df in (("auc", oot_c), ("auc_relative", oot_rel)):
        one = bootstrap.bootstrap_auc(df, C.LABEL, "prediction", KEY, bootstrap_n, cfg.seed, name)
        intervals.append(bootstrap.interval(one, [name]))
    ev["ci"] = intervals[0].unionByName(intervals[1]).unionByName(intervals[2])
    ev["roc_oot"] = classification.roc_curve(oot_c, C.LABEL, "prediction")
    ev["calibration_clf_oot"] = classification.calibration_table(oot_c, C.LABEL, "prediction", KEY)
    ev["psi_table"] = stability.psi_table(test, oot, "prediction")
    ev["psi_score"] = stability.psi(test, oot, "prediction")
    ev["csi"] = stability.csi(parts.train, parts.test, parts.oot, cfg.features)
    ev["subgroups_oot"] = segments.segment_calibration(claims.with_bands(full), claims.SEGMENTS, C.TARGET, "p_norm")
    ev["segment_status"] = segments.segment_status(ev["subgroups_oot"])
    ev["fairness_oot"] = fairness_table(full, "p_class")
    sample = explain.explain_sample(parts.test.select(KEY, C.TARGET, *cfg.features), KEY, cfg.seed)
    model = models.cost[champion]
    ev["perm_importance"] = materialize(
        explain.permutation_importance(model, sample, cfg.features, C.TARGET, KEY, seed=cfg.seed), "evidence")
    ev["pdp"] = explain.partial_dependence(
        model, sample, explain.top_features(ev["perm_importance"]), cfg.features)
    ev["sensitivity"] = explain.input_shocks(model, parts.oot, cfg.features)
    ev["mono_table"] = segments.monotonicity(full, "n_chronic", "p")
    if with_refits:
        ev["robustness"] = materialize(robustness(parts.train, parts.oot, refits(cfg, budget)), "evidence")
    ev["scored_members"] = scored_members(full, "p", "p_class")
    members = materialize(ev["scored_members"], "members")
    ev["scored_members"] = members
    ev["decile_backtest"] = decile_backtest(members)
    ev["summary_kpis"] = summary_kpis(members)
    ev["ratio_crosstab"] = segments.ratio_crosstab(
        members, "age_band", "sex", ["Female", "Male"], "actual_cost", "predicted_cost",
        factor=ev["norm_factor"].first()[0])
    row = rules.champion_row(ev["reg_comparison"], champion, challenger, cfg.oot_sample)
    parts_found = [
        rules.from_checks(dq), rules.from_metrics(row, ev["psi_score"], dq), rules.from_csi(ev["csi"]),
        rules.from_segments(ev["subgroups_oot"]), rules.from_fairness(ev["fairness_oot"]),
        rules.from_benchmark(row), rules.from_monotonicity(segments.is_monotonic(ev["mono_table"])),
        rules.standing(dq.sparkSession)]
    if with_refits:
        parts_found.append(rules.from_robustness(ev["robustness"]))
    ev["findings"] = materialize(rules.numbered(parts_found), "evidence")
    ev["severity_counts"] = rules.severity_counts(ev["findings"])
    ev["rating"] = rules.rating(ev["findings"])
    return ev


def run_all(raw: RawTables, cfg: C.ClaimsConfig = C.ClaimsConfig(), budget: BoostingBudget = BoostingBudget(),
            **options) -> dict[str, DataFrame]:
    """From staged raw tables to all evidence: features, data quality, models, validation, findings."""
    raw, seen = quality.stored(raw, cfg.years)
    base = materialize(claims.model_base(raw, cfg), "base")
    matrix = materialize(claims.feature_matrix(claims.eligible(base), cfg), "matrix")
    recon = materialize(quality.reconciliation(raw.inpatient, raw.members), "evidence")
    dq = materialize(quality.run_suite(raw, cfg.years, recon, seen), "evidence")
    parts = claims.split(matrix, cfg)
    ev = validate(parts, fit_models(parts.train, cfg, budget), cfg, dq, budget, **options)
    wide = pivot_periods(claims.population_waterfall(base), ["step", "rule"], "feature_year", "n",
                         [cfg.dev_year, cfg.oot_year])
    return {**ev, "dq": dq, "recon": recon, "waterfall": claims.population_waterfall(base), "waterfall_pivot": wide,
            "negative_targets": claims.count_negative_targets(claims.eligible(base))}

