"""The registered queries: complete shapes, and equal results on the SQL side for a quick selection."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from actuspark.catalogue import oracles
from actuspark.catalogue import queries as registered
from actuspark.catalogue.shapes import SHAPES

SF = "/root/testdata/sf0.001"
QUICK = ["member_year", "lenient_cast", "yyyymmdd_parse", "readmissions", "visits", "code_groups", "population_waterfall",
         "dq_suite", "quantiles", "global_rank", "reg_metrics", "clf_metrics", "psi_score", "segment_calibration",
         "monitoring_status", "bootstrap_auc", "bootstrap_auc_relative", "boosting_steps", "saturated_fits", "csv_round_trip"]


def test_every_query_has_a_shape():
    assert set(registered.queries()) == set(SHAPES)
    assert set(oracles.oracle_sql()) <= set(SHAPES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    mine = entry.queries()[name](spark, SF).toArrow()
    assert differences(mine, connect(SF).sql(entry.oracle_sql()[name]).to_arrow_table()) is None


def test_persistence_is_explained_on_the_rows_of_its_sql(spark, monkeypatch):
    sql = entry.oracle_sql()
    assert f"LIMIT {registered.PERSISTENCE_ROWS})" in sql["importance_of_persistence"]
    monkeypatch.setattr(registered, "PERSISTENCE_ROWS", 20)  # fewer than the test tables have
    for name in ("importance_of_persistence", "dependence_of_persistence"):
        theirs = connect(SF).sql(sql[name].replace("LIMIT 6000)", "LIMIT 20)")).to_arrow_table()
        assert differences(entry.queries()[name](spark, SF).toArrow(), theirs) is None


def test_segment_breaches_looks_at_segments_of_50_rows(spark):
    rows = connect("/root/testdata/sf0.01").sql(entry.oracle_sql()["segment_breaches"]).to_arrow_table()
    mine = entry.queries()["segment_breaches"](spark, "/root/testdata/sf0.01").toArrow()
    assert differences(mine, rows) is None
    status = dict(zip(zip(mine["dimension"].to_pylist(), mine["level"].to_pylist()), mine["status"].to_pylist()))
    outside = {(r["dimension"], r["level"]) for r in mine.to_pylist()
               if 50 <= r["n"] < 500 and not 0.85 <= r["pred_mean"] / r["actual_mean"] <= 1.15}
    assert outside and all(status[s] == "BREACH" for s in outside)
