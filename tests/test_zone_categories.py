"""The classifier over zones as categories and, as published, as one feature a zone."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from samples import ZONE_SERIES_SCHEMA, zone_series
from test_models import SETTINGS

from curbflow.operators.series import TIME_FEATURES
from curbflow.plans import model_runs as runs
from curbflow.plans import model_store as store


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(zone_series(), ZONE_SERIES_SCHEMA)


@pytest.mark.parametrize("categories", [False, True])
def test_both_forms_learn_and_differ_in_width_alone(spark, zones, categories):
    run = runs.run_classification(zones, replace(SETTINGS, zones_as_categories=categories))
    rows = run.frames["classification"]
    assert rows.count() == run.metrics["test_rows"]
    assert run.metrics["auc_roc"] > 0.8
    size = run.model.stages[-1].numFeatures
    count = zones.select("pickup_location_id").distinct().count()
    # One-hot vectors also have a place for zones unseen in training, and one for invalid ones.
    assert size == (len(TIME_FEATURES) + 1 if categories else len(TIME_FEATURES) + count + 2)
    stages = len(run.model.stages)
    assert stages == (3 if categories else 4)
    run.release()


def test_more_zones_than_default_bins_and_an_unseen_one(spark, zones, tmp_path):
    many = zones.where("pickup_location_id % 3 = 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("copy")).withColumn(
        "pickup_location_id", F.col("pickup_location_id") + 1000 * F.col("copy")
    ).drop("copy")
    assert many.select("pickup_location_id").distinct().count() > 32
    settings = replace(SETTINGS, zones_as_categories=True, classify_trees=4, classify_depth=3)
    run = runs.run_classification(many, settings)
    store.publish_model(run, str(tmp_path / "forest"), spark)
    stored = store.load_model(spark, str(tmp_path / "forest"))
    rows = store.feature_rows(run.name, many).limit(5).withColumn("zone_id", F.lit("99999"))
    assert {r.prediction for r in store.predict(stored, rows).collect()} <= {0.0, 1.0}
    run.release()
