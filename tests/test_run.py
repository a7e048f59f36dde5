"""Sources, sinks, quality rules, findings, and a whole run over raw text files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from actuspark import config as C
from actuspark.catalogue.queries import queries
from actuspark.ml.registry import BoostingBudget
from actuspark.operators import quality
from actuspark.plans import claims, findings, starviews, validation
from actuspark.sources import readers, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw_folder(spark, tmp_path_factory):
    """The derived raw tables as header CSV files under the default file names."""
    root = tmp_path_factory.mktemp("raw")
    files = readers.default_files(starviews.STAR_CONFIG)
    parts = {f"bene_{y}": df for y, df in starviews.star_member_files(spark, SF).items()}
    parts["inpatient"] = starviews.star_claims(spark, SF, "inpatient")
    parts["outpatient"] = starviews.star_claims(spark, SF, "outpatient")
    for name, df in parts.items():
        df.toPandas().to_csv(root / files[name], index=False)
    return str(root)


def test_missing_sources_are_listed(spark, tmp_path):
    with pytest.raises(readers.MissingSources) as error:
        readers.load_raw(spark, str(tmp_path), starviews.STAR_CONFIG)
    for name in readers.default_files(starviews.STAR_CONFIG).values():
        assert name in str(error.value)


def test_text_scan_prunes_columns_and_reads_missing_texts_as_null(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1,,x\nNA,02,nan\n")
    df = readers.scan_text(spark, str(path), ["b", "a"])
    assert df.columns == ["b", "a"] and [tuple(r) for r in df.collect()] == [(None, "1"), ("02", None)]
    with pytest.raises(ValueError):
        readers.scan_text(spark, str(path), ["zz"])


def test_loaded_tables_equal_the_views(spark, raw_folder):
    raw, sources = readers.load_raw(spark, raw_folder, starviews.STAR_CONFIG)
    counts = {r["source"]: r["n_rows"] for r in readers.source_counts(sources).collect()}
    assert counts["inpatient"] == starviews.star_claims(spark, SF, "inpatient").count()
    assert sum(v for k, v in counts.items() if k.startswith("bene")) == raw.members.count()
    a = claims.member_year(raw.members)
    b = claims.member_year(starviews.star_members(spark, SF))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_order_lines_are_read_once_for_both_claim_tables(spark, monkeypatch):
    read, tables = [], starviews.tables
    monkeypatch.setattr(starviews, "tables", lambda spark, d, *names: read.extend(names) or tables(spark, d, *names))
    raw = starviews.staged_raw(spark, SF)
    assert read.count("lineitem") == 1
    queries()["csv_round_trip"](spark, SF)
    assert read.count("lineitem") == 2
    monkeypatch.undo()
    for mine, kind in ((raw.inpatient, "inpatient"), (raw.outpatient, "outpatient")):
        plain = starviews.star_claims(spark, SF, kind)
        assert mine.dtypes == plain.dtypes
        assert mine.exceptAll(plain).count() == 0 and plain.exceptAll(mine).count() == 0


def test_findings_store_the_raw_tables_once(spark, monkeypatch):
    read, tables = [], starviews.tables
    monkeypatch.setattr(starviews, "tables", lambda spark, d, *names: read.extend(names) or tables(spark, d, *names))
    queries()["findings_rating"](spark, SF)
    assert read.count("lineitem") == 1 and read.count("customer") == 1


def test_evidence_sink_writes_null_for_infinity(spark, tmp_path):
    df = spark.createDataFrame([(1, float("-inf"), float("nan"), 2.5)], "bin int, lower double, x double, y double")
    sinks.write_evidence({"psi": df}, str(tmp_path))
    lines = [line for f in (tmp_path / "psi").glob("*.json") for line in f.read_text().splitlines()]
    assert [json.loads(line) for line in lines] == [{"bin": 1, "lower": None, "x": None, "y": 2.5}]


def test_stage_is_replaced_and_provenance_marked(spark, tmp_path):
    path = str(tmp_path / "stage")
    sinks.write_stage(spark.range(5), path)
    again = sinks.write_stage(spark.range(3).withColumn("year", F.lit(2008)), path, "year")
    assert again.count() == 3
    marked = sinks.provenance(again, generated=True).first()
    assert marked["generated_data"] is True and "NOT REAL" in marked["data_source"]
    meta = sinks.run_metadata(spark, False, n_train=7).first()
    assert meta["generated_data"] is False and meta["n_train"] == 7


def test_own_stages_can_be_dropped(spark, tmp_path):
    from actuspark import session

    kept = sinks.write_stage(spark.range(4), str(tmp_path / "kept"))
    stage = session.materialize(spark.range(9), "gone")
    files = stage.inputFiles()
    assert stage.count() == 9 and session.drop_stages(spark) >= 1
    assert session.drop_stages(spark) == 0 and kept.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()


def test_status_rule(spark):
    rows = [(0.0, 0.0, "max"), (0.1, 0.0, "max"), (0.05, 0.05, "max"), (0.25, 0.05, "max"), (0.2501, 0.05, "max"),
            (8.0, 10.0, "min"), (7.9, 10.0, "min"), (10.0, 10.0, "min"), (5.0, 0.0, "info")]
    df = spark.createDataFrame(rows, "v double, t double, r string")
    got = [r[0] for r in df.select(quality.status(F.col("v"), F.col("t"), F.col("r"))).collect()]
    assert got == ["PASS", "FAIL", "PASS", "WARN", "FAIL", "WARN", "FAIL", "PASS", "INFO"]


def test_missing_observation_counts_as_zero(spark):
    none = spark.createDataFrame([("DQ-16", None)], "check_id string, observed double")
    row = quality.graded(none, quality.suite((2008, 2009, 2010))).filter("check_id = 'DQ-16'").first()
    assert row["observed"] == 0.0 and row["status"] == "PASS"


def test_published_reconciliation_arithmetic(spark):
    df = spark.createDataFrame([(2008, 100.0), (2009, 59.0)], "year int, mean_paid double")
    from actuspark.operators.sequences import period_change

    assert period_change(df, "year", "mean_paid").filter("year = 2009").first()["change"] == pytest.approx(-0.41)


def metrics_frame(spark, o_ratio, t_r2, on_r2, tr_r2, on_cpm, ch_cpm):
    cols = "model string, sample string, r2 double, cpm double, gini double, predictive_ratio double, mean_actual double, mean_predicted double"
    row = lambda m, s, r2=0.2, cpm=0.2, pr=1.0: (m, s, r2, cpm, 0.6, pr, 100.0, 100.0 * pr)
    return spark.createDataFrame([
        row(C.M3, C.TRAIN, tr_r2), row(C.M3, C.TEST, t_r2, pr=1.016), row(C.M3, "OOT", 0.1, pr=o_ratio),
        row(C.M3, C.NORMALISED, on_r2, on_cpm), row(C.M2, C.NORMALISED, 0.1, ch_cpm)], cols)


def test_findings_of_the_published_run(spark):
    """The published metrics give one High finding, hence 'Needs improvement'."""
    dq = spark.createDataFrame(
        [("DQ-18", "Largest yearly move", 0.4086, 0.05, "FAIL"), ("DQ-09", "Negative", 0.002, 0.001, "WARN"),
         ("DQ-04", "Dup", 0.0, 0.0, "PASS")],
        "check_id string, description string, observed double, threshold double, status string")
    row = findings.champion_row(metrics_frame(spark, 1.935, 0.295, 0.123, 0.33, 0.165, 0.155), C.M3, C.M2, "OOT")
    psi = spark.createDataFrame([(0.046,)], "psi double")
    csi = spark.createDataFrame([("n_chronic", 0.30), ("age", 0.02)], "feature string, csi double")
    seg = spark.createDataFrame([("age_band", "<65", 900, 0.70), ("sex", "Male", 900, 1.0)],
                                "dimension string, level string, n int, predictive_ratio double")
    fair = spark.createDataFrame([("race", "White", 0.75), ("race", "Black", 0.69), ("sex", "Male", 0.5)],
                                 "dimension string, level string, auc double")
    rob = spark.createDataFrame([("seed", 0.12), ("seed", 0.16), ("hyperparameter", 0.9)], "group string, r2_norm double")
    mono = spark.createDataFrame([(False,)], "monotonic boolean")
    found = findings.numbered([
        findings.from_checks(dq), findings.from_metrics(row, psi, dq), findings.from_csi(csi), findings.from_segments(seg),
        findings.from_fairness(fair), findings.from_benchmark(row), findings.from_robustness(rob),
        findings.from_monotonicity(mono), findings.standing(spark)])
    rows = {r["finding"]: r for r in found.collect()}
    assert sorted(r["id"] for r in rows.values()) == [f"F-{i:02d}" for i in range(1, 12)]
    calibration = rows["Out-of-time totals outside the 5 % tolerance"]
    assert calibration["severity"] == "High" and "1.935" in calibration["evidence"] and "40.9 %" in calibration["evidence"]
    assert rows["Feature distributions have shifted (CSI above 0.10)"]["evidence"] == "n_chronic=0.30"
    assert rows["Segments mis-calibrated (ratio outside 0.85-1.15)"]["evidence"] == "age_band=<65: 0.70"
    assert "Champion hardly better than the simpler challenger" not in rows  # lift is 0.01
    verdict = findings.rating(found).first()
    assert verdict["n_high"] == 1 and verdict["rating"].startswith("Needs improvement")


def test_rating_steps(spark):
    make = lambda *s: spark.createDataFrame([(x,) for x in s], "severity string")
    first = lambda df: findings.rating(df).first()["rating"].split(" -")[0]
    assert first(make("High", "High")) == "Unsatisfactory" and first(make("High", "Low")) == "Needs improvement"
    assert first(make("Medium")) == "Satisfactory with findings" and first(make("Low")) == "Satisfactory"
    counts = {r["severity"]: r["n"] for r in findings.severity_counts(make("Low", "Low", "High")).collect()}
    assert counts == {"Low": 2, "High": 1}


def test_traffic_lights(spark):
    rows = [("psi", 0.05, None), ("psi", 0.1, None), ("csi", 0.26, None), ("ratio", 1.05, None), ("ratio", 0.92, None),
            ("ratio", 1.2, None), ("segment_ratio", 0.9, None), ("segment_ratio", 0.86, None), ("auc", 0.79, 0.80),
            ("auc", 0.76, 0.80), ("auc", 0.70, 0.80), ("psi", None, None)]
    df = spark.createDataFrame(rows, "m string, v double, r double")
    got = [r[0] for r in df.select(findings.traffic_light(F.col("m"), F.col("v"), F.col("r"))).collect()]
    assert got == ["Green", "Amber", "Red", "Green", "Amber", "Red", "Green", "Amber", "Green", "Amber", "Red", None]


def test_next_year_join_and_waterfall_edges(spark):
    cols = ["bene_id", "year", "paid_total", "paid_ip", "part_a_mos", "part_b_mos", "death_dt"]
    rows = [("stays", 2008, 10.0, 1.0, 12, 12, None), ("stays", 2009, 20.0, 2.0, 12, 0, None),
            ("leaves", 2008, 10.0, 1.0, 12, 12, None),
            ("died", 2008, 10.0, 1.0, 12, 12, 20080505), ("died", 2009, 5.0, 1.0, 12, 12, 20080505),
            ("uncovered", 2008, 10.0, 1.0, 0, 0, None), ("uncovered", 2009, 10.0, 1.0, 0, 0, None),
            ("unknown", 2008, 10.0, 1.0, None, 0, None), ("unknown", 2009, 10.0, 1.0, 1, None, None)]
    df = spark.createDataFrame(rows, "bene_id string, year int, paid_total double, paid_ip double, part_a_mos int, part_b_mos int, death_dt int")
    base = claims.with_eligibility(claims.next_year(df.select(cols))).filter("year = 2008")
    flags = {r["bene_id"]: r for r in base.collect()}
    assert flags["stays"]["target_paid"] == 20.0 and flags["leaves"]["elig_in_next_year"] == 0
    assert flags["unknown"]["elig_base_coverage"] is None and flags["unknown"]["elig_next_coverage"] == 1
    steps = {r["step"]: r["n"] for r in claims.population_waterfall(base).collect()}
    assert steps == {1: 5, 2: 4, 3: 2, 4: 1, 5: 1}
    assert [r["bene_id"] for r in claims.eligible(base).collect()] == ["stays"]


def test_floor_keeps_the_raw_target(spark):
    df = spark.createDataFrame([(-5.0, -1.0, None, 2.0, 1.0, 3.0)],
                               "target_paid double, paid_ip double, paid_op double, paid_car double, paid_total double, benres_total double")
    row = claims.floor_amounts(df).first()
    assert row["target_paid_raw"] == -5.0 and row["target_paid"] == 0.0 and row["paid_ip"] == 0.0 and row["paid_op"] == 0.0
    assert row["log_paid_total"] == pytest.approx(math.log(2.0))
    assert claims.count_negative_targets(df).first()[0] == 1


def test_leakage_names():
    assert validation.forbidden_features(C.FEATURES) == []
    assert validation.forbidden_features((*C.FEATURES, "target_paid_ip", "race_cd")) == ["target_paid_ip", "race_cd"]
    assert len(C.FEATURES) == 44


def test_whole_run_from_text_files(spark, raw_folder, tmp_path):
    raw, _ = readers.load_raw(spark, raw_folder, starviews.STAR_CONFIG)
    budget = BoostingBudget(cost_rounds=2, class_rounds=2, cost_rate=0.3, class_rate=0.3, min_leaf_cost=5, min_leaf_class=5)
    ev = validation.run_all(raw, starviews.STAR_CONFIG, budget, bootstrap_n=8, with_refits=False)
    sinks.write_evidence(ev, str(tmp_path))
    assert ev["reg_comparison"].count() == 16 and ev["clf_comparison"].count() == 8
    assert ev["dq"].count() == 18 and ev["decile_backtest"].count() == 11
    normalised = ev["reg_comparison"].filter(F.col("sample") == C.NORMALISED).select("predictive_ratio").collect()
    assert all(r[0] == pytest.approx(1.0) for r in normalised)
    assert ev["rating"].count() == 1 and ev["ci"].count() == 7
    assert all(list((tmp_path / name).glob("*.json")) for name in ev)
