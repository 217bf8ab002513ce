from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import DAILY_SCHEMA, ZONE_SERIES_SCHEMA, daily_series, zone_series

from curbflow.operators import series
from curbflow.plans import model_runs as runs
from curbflow.plans.verification import metric_bounds
from curbflow.settings import ModelSettings

SETTINGS = ModelSettings(
    seed=17,
    forecast_test_days=21,
    forecast_trees=5,
    forecast_depth=3,
    cluster_iterations=12,
    classify_test_days=21,
    classify_trees=12,
    classify_depth=5,
)


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(zone_series(), ZONE_SERIES_SCHEMA)


@pytest.fixture(scope="module")
def forecast(spark):
    return runs.run_forecast(spark.createDataFrame(daily_series(), DAILY_SCHEMA), SETTINGS)


def test_forecast_covers_the_horizon_of_every_series(forecast):
    rows = forecast.frames["forecast"].collect()
    assert len(rows) == 60 and {r.horizon_day for r in rows} == set(range(1, 31))
    assert all(r.forecast_trips >= 0 and r.forecast_lower_95 >= 0 for r in rows)
    assert all(r.forecast_upper_95 >= r.forecast_trips for r in rows)
    assert all(math.isfinite(forecast.metrics[m]) for m in ("rmse", "mae", "r2", "wmape_percent"))


def test_carried_state_equals_recomputing_every_window(spark, forecast):
    """The state-array recursion against the plain one: append, rebuild all features, predict."""
    daily = series.daily_service(spark.createDataFrame(daily_series(), DAILY_SCHEMA))
    history = series.complete_panel(daily, entity="service_type").toPandas()
    expected = {}
    for step in range(1, 4):
        ahead = (
            history.groupby("service_type")["trip_date"].max().reset_index()
        )
        ahead["trip_date"] = ahead["trip_date"].map(lambda d: d.fromordinal(d.toordinal() + 1))
        ahead["trip_count"] = float("nan")
        frame = spark.createDataFrame(
            pd.concat([history, ahead])[["service_type", "trip_date", "trip_count"]],
            "service_type string, trip_date date, trip_count double",
        )
        known = frame.withColumn("trip_count", F.when(~F.isnan("trip_count"), F.col("trip_count")))
        candidates = series.time_features(known, entity="service_type").where("trip_count IS NULL")
        scored = forecast.model.transform(candidates).select("service_type", "trip_date", "prediction").collect()
        for row in scored:
            value = max(0.0, row.prediction)
            expected[row.service_type, step] = value
            history.loc[len(history)] = {"service_type": row.service_type, "trip_date": row.trip_date, "trip_count": value}
    got = {
        (r.service_type, r.horizon_day): r.forecast_trips
        for r in forecast.frames["forecast"].where("horizon_day <= 3").collect()
    }
    assert got == pytest.approx(expected)


def test_short_series_are_refused(spark, forecast):
    short = spark.createDataFrame(daily_series(20), DAILY_SCHEMA)
    panel = series.complete_panel(series.daily_service(short), entity="service_type")
    with pytest.raises(ValueError, match="fewer than 28 days"):
        runs.recursive_forecast(forecast.model, panel, horizon_days=2, rmse=1.0)


def test_segmentation_keeps_every_zone_and_trip(zones):
    run = runs.run_segmentation(zones, SETTINGS)
    segments = run.frames["segments"]
    assert segments.count() == 12
    assert segments.select("segment_id").distinct().count() == 4
    total = zones.agg(F.sum("trip_count")).first()[0]
    assert segments.agg(F.sum("total_trips")).first()[0] == total
    profiles = run.frames["profiles"].orderBy("demand_rank").collect()
    assert [p.segment_label for p in profiles] == list(runs.SEGMENT_LABELS)
    assert sum(p.trip_share for p in profiles) == pytest.approx(1.0)
    assert run.metrics["silhouette"] > 0
    run.release()


def test_segmentation_needs_distinct_vectors(spark):
    same = spark.createDataFrame([(str(i), 5.0) for i in range(6)], "zone_id string, trips double")
    with pytest.raises(ValueError, match="distinct vectors"):
        runs.run_segmentation(same, SETTINGS)


def test_classification_confusion_sums_to_the_holdout(zones):
    run = runs.run_classification(zones, SETTINGS)
    cells = run.frames["confusion"].collect()
    assert len(cells) == 4
    assert sum(c["count"] for c in cells) == run.metrics["test_rows"] == 12 * 21
    assert run.frames["classification"].count() == run.metrics["test_rows"]
    for name in ("auc_roc", "accuracy", "f1", "weighted_precision", "weighted_recall"):
        assert 0 <= run.metrics[name] <= 1
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    scored = run.frames["classification"].select("label", "prediction")
    judge = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    for ours, theirs in (("accuracy",) * 2, ("f1",) * 2, ("weighted_precision", "weightedPrecision")):
        assert run.metrics[ours] == pytest.approx(judge.setMetricName(theirs).evaluate(scored))
    run.release()


def test_one_class_is_refused(spark):
    flat = [(r[0], r[1], r[2], r[3], r[4], 5, *r[6:]) for r in zone_series(90, 4)]
    with pytest.raises(ValueError, match="both classes"):
        runs.run_classification(spark.createDataFrame(flat, ZONE_SERIES_SCHEMA), SETTINGS)


def test_holdout_of_one_class_is_scored_without_a_curve(spark):
    """Demand falls before the holdout: no zone-day there is busy."""
    rows = zone_series(120, 4)
    calm = [(r[0], r[1], r[2], r[3], r[4], r[5] if r[0].toordinal() - rows[0][0].toordinal() < 95 else 1, *r[6:]) for r in rows]
    run = runs.run_classification(spark.createDataFrame(calm, ZONE_SERIES_SCHEMA), SETTINGS)
    assert {r.actual_high_demand for r in run.frames["classification"].collect()} == {0}
    cells = {(c["actual_label"], c["predicted_label"]): c["count"] for c in run.frames["confusion"].collect()}
    assert sum(cells.values()) == run.metrics["test_rows"] == 4 * 21 and cells[1, 0] == cells[1, 1] == 0
    assert run.metrics["accuracy"] == cells[0, 0] / (4 * 21)
    auc = run.frames["classification_metrics"].where("metric_name = 'auc_roc'").first()
    assert auc.metric_value is None and not metric_bounds(run.frames["classification_metrics"]).where("metric_name = 'auc_roc'").first().in_range
    run.release()


def test_confusion_measure_has_the_classes_of_the_holdout(spark, monkeypatch):
    from curbflow.workload import model_queries

    cells = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 0, 0), (1, 1, 0)], "actual_label int, predicted_label int, count bigint")
    monkeypatch.setattr(model_queries, "result", lambda *_: cells)
    assert [tuple(r) for r in model_queries.measures_confusion(spark, "").collect()] == [(0, 7)]


def test_metric_rows_and_bounds(spark):
    frame = runs.metrics_frame(
        spark, "kmeans_zones", {"k": 4, "ok": True, "silhouette": float("nan"), "cut": None, "tag": "x"}
    )
    rows = {r.metric_name: (r.metric_value, r.metric_text) for r in frame.collect()}
    assert rows == {"k": (4.0, None), "ok": (1.0, "true"), "silhouette": (0.0, None), "cut": (None, None), "tag": (None, "x")}
    bad = {(r.model_name, r.metric_name) for r in metric_bounds(frame).where("NOT in_range").collect()}
    assert ("kmeans_zones", "zones") in bad and ("kmeans_zones", "k") not in bad


def test_models_and_contracts_are_published(spark, zones, tmp_path):
    from pyspark.ml import PipelineModel

    from curbflow.operators.audit import event, events_frame, flatten_events
    from curbflow.plans.contracts import CONTRACTS
    from curbflow.plans.pipeline import LakePaths, build_models, publish_contracts

    lake = LakePaths(str(tmp_path / "lake"))
    daily = zones.selectExpr("*", "2023 AS pickup_year", "month(pickup_date) AS pickup_month")
    for name in ("daily", "hourly", "finance", "routes", "tips", "anomalies"):
        daily.limit(50).write.parquet(lake.mart(name)) if name != "daily" else daily.write.parquet(lake.mart(name))
    runs_by_kind = build_models(spark, lake, SETTINGS)
    assert set(runs_by_kind) == {"forecast", "segmentation", "classification"}
    metrics = spark.read.parquet(lake.layer("results", "model_metrics", "parquet"))
    assert metrics.select("model_name").distinct().count() == 3
    assert metric_bounds(metrics).where("NOT in_range").count() == 0
    assert len(PipelineModel.load(lake.layer("models", "forecast")).stages) == 4
    audit = flatten_events(events_frame(spark, [event("pipeline_run", "SUCCEEDED")]))
    written = publish_contracts(spark, lake, audit)
    assert set(written) == set(CONTRACTS)
    assert spark.read.option("header", "true").csv(written["D07_Pronostico"]).count() == 60
