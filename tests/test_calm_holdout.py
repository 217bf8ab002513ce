"""The classifier's queries over trips that fall before the holdout, so that no holdout day is busy."""

from __future__ import annotations

from pathlib import Path

import pytest

from curbflow.plans.pipeline import LakePaths, build_models
from curbflow.settings import ModelSettings
from curbflow.workload import all_queries, model_queries
from curbflow.workload.trips import mart

TABLES = Path("/root/testdata/sf0.01")
SMALL = ModelSettings(forecast_trees=2, forecast_depth=2, classify_trees=4, classify_depth=4)
HOLDOUT_ROWS = 25 * 90  # zones, days


@pytest.fixture(scope="module")
def calm(spark, tmp_path_factory):
    """The small tables with most orders of a period's days after the 85th dated into its first 85."""
    folder = tmp_path_factory.mktemp("calm")
    for path in TABLES.iterdir():
        if path.stem != "orders":
            (folder / path.name).symlink_to(path)
    day = "datediff(CAST(o_orderdate AS date), DATE'1995-01-01') % 180"
    moved = f"o_orderdate - make_dt_interval(CASE WHEN o_orderkey % 29 <> 0 THEN {day} DIV 85 * 85 ELSE 0 END)"
    orders = spark.read.parquet(str(TABLES / "orders.parquet"))
    orders.selectExpr("* EXCEPT (o_orderdate)", f"CAST({moved} AS timestamp) AS o_orderdate").write.parquet(str(folder / "orders.parquet"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(model_queries, "SETTINGS", SMALL)
        yield str(folder)


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("classify_demand", HOLDOUT_ROWS),
        ("classification_actuals", HOLDOUT_ROWS),
        ("classification_accuracy", 1),
        ("confusion_recount", 4),
        ("confusion_matrix", 4),
        ("contract_d09", HOLDOUT_ROWS),
        ("measures_confusion", 1),
        ("measures_classify", 25),
        ("page_09", None),
        ("star_classification", HOLDOUT_ROWS),
        ("model_metrics", None),
        ("metric_bounds", None),
        ("measures_model", 6),
        ("stored_model_faults", 2),
    ],
)
def test_a_calm_holdout_has_results(spark, calm, name, rows):
    got = all_queries()[name](spark, calm).collect()
    assert len(got) == rows if rows else got
    if name == "classification_actuals":
        assert {r.actual_high_demand for r in got} == {0}
    if name == "measures_model":
        values = {r.measure: r.value for r in got}
        assert [m for m, v in values.items() if v is None] == ["auc"], values
    if name == "metric_bounds":
        assert [r.metric_name for r in got if r.metric_value is None] == ["auc_roc"]
    if name == "stored_model_faults":
        assert {(r.check, r.passed, r.violations) for r in got} == {("as saved", True, 0), ("faulty", False, 3)}


def test_a_run_publishes_models_with_a_calm_holdout(spark, calm, tmp_path):
    """The step of the full runs that fits, scores and stores the models of a lake."""
    lake = LakePaths(str(tmp_path / "lake"))
    mart(spark, calm, "daily").write.parquet(lake.mart("daily"))
    assert set(build_models(spark, lake, SMALL)) == {"forecast", "segmentation", "classification"}
    metrics = spark.read.parquet(lake.layer("results", "model_metrics", "parquet"))
    assert [r.metric_name for r in metrics.where("metric_value IS NULL AND metric_text IS NULL").collect()] == ["auc_roc"]
