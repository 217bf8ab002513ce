"""Saved models: loaded, applied to new days, and found unusable when they are."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from samples import DAILY_SCHEMA, daily_series
from test_models import SETTINGS

from curbflow.plans import model_runs as runs
from curbflow.plans import model_store as store
from curbflow.sources.sinks import delete_path


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    daily = spark.createDataFrame(daily_series(), DAILY_SCHEMA)
    run = runs.run_forecast(daily, SETTINGS)
    path = str(tmp_path_factory.mktemp("models") / "forecast")
    store.publish_model(run, path, spark)
    return run, path, store.feature_rows(run.name, daily)


def test_loaded_model_predicts_as_the_fitted_one(spark, saved):
    run, path, rows = saved
    stored = store.load_model(spark, path)
    assert stored.features == runs.TIME_FEATURES and stored.cutoff == run.metrics["temporal_cutoff"]
    both = store.predict(stored, store.predict(replace(stored, model=run.model), rows, "fitted"), "loaded")
    assert both.count() == rows.count() > 0
    assert both.where("NOT fitted <=> loaded").isEmpty()
    assert store.new_days(stored, rows).agg(F.min("trip_date")).first()[0] > stored.cutoff
    assert store.new_days(stored, rows).count() == 2 * SETTINGS.forecast_test_days


def test_missing_features_are_named(spark, saved):
    _, path, rows = saved
    with pytest.raises(ValueError, match="lag_7.*service_type"):
        store.predict(store.load_model(spark, path), rows.drop("lag_7", "service_type"))


def test_unusable_models(spark, saved, tmp_path):
    run, path, _ = saved
    assert store.unusable_models(spark, {run.name: path}).isEmpty()
    found = store.unusable_models(spark, {runs.SEGMENT_MODEL: path, runs.CLASSIFY_MODEL: f"{tmp_path}/none"}).collect()
    assert {r.name for r in found} == {runs.SEGMENT_MODEL, runs.CLASSIFY_MODEL}
    broken = str(tmp_path / "broken")
    store.publish_model(run, broken, spark)
    delete_path(spark, f"{broken}/stages")
    assert [r.name for r in store.unusable_models(spark, {run.name: broken}).collect()] == [run.name]


def test_layout_of_training_rows_follows_their_size(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS entity", "id / 2 AS value").repartition(8)
    laid = runs._training_order(rows, "entity", "id")
    assert laid.rdd.getNumPartitions() == 1 and laid.count() == 1000
    laid.unpersist()
    monkeypatch.setattr(runs, "TRAINING_BYTES", 10_000)
    laid = runs._training_order(rows, "entity", "id")
    assert laid.rdd.getNumPartitions() == 4 and laid.count() == 1000
    laid.unpersist()
