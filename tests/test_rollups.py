"""Mergeable route medians and the segmentation recomputed from its centres, on small tables."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from curbflow.operators import marts
from curbflow.operators.zone_features import ZONE_FEATURES
from curbflow.plans.model_runs import nearest_centres, silhouettes, standardised


def trips(spark, minutes):
    rows = [(m, 1 + i % 2, 1 + i % 3) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "trip_duration_minutes double, pickup_location_id int, dropoff_location_id int").selectExpr(
        "*", "timestamp '2023-05-01' AS pickup_datetime", "'yellow' AS service", "'B' AS pickup_borough", "'Z' AS pickup_zone",
        "cast(null AS string) AS dropoff_borough", "'Y' AS dropoff_zone", "2D AS total_amount", "0D AS trip_distance",
    )


@pytest.mark.parametrize("count", [0, 1, 2, 7, 20_000])
def test_median_of_merged_sketches(spark, count):
    minutes = [float((i * 7919) % 10_007) for i in range(count)] + [None, None]
    base = marts.route_base(trips(spark, minutes))
    [row] = marts.route_rollup(base, "service").collect()
    known = sorted(m for m in minutes if m is not None)
    assert row.trip_count == count + 2 and row.avg_fare_per_mile is None
    if not known:
        assert row.median_trip_duration_minutes is None
        return
    at = [known[max(0, math.ceil(len(known) * p) - 1)] for p in (0.5 - marts.SKETCH_RANK_ERROR, 0.5 + marts.SKETCH_RANK_ERROR)]
    assert at[0] <= row.median_trip_duration_minutes <= at[1]


def test_a_rollup_reads_no_trips_and_the_sums_hash(spark, tmp_path):
    marts.route_base(trips(spark, [1.0, 2.0, None])).write.parquet(str(tmp_path / "routes"))
    base = spark.read.parquet(str(tmp_path / "routes"))
    assert marts.route_rollup(base, "pickup_location_id").count() == 2
    assert base.where("duration_sketch IS NULL").count() == 1


def test_nearest_and_silhouette_equal_the_evaluator(spark):
    rows = [(str(i), i % 3, *[float((i * (j + 3)) % 11 + 9 * (i % 3)) for j in range(len(ZONE_FEATURES) - 1)], 5.0) for i in range(40)]
    frame = spark.createDataFrame(rows, ["zone_id", "segment_id", *ZONE_FEATURES])
    zones = standardised(frame).cache()
    assert {r.z[-1] for r in zones.collect()} == {0.0}
    vectors = zones.withColumn("v", array_to_vector("z"))
    want = ClusteringEvaluator(featuresCol="v", predictionCol="segment_id").evaluate(vectors)
    assert silhouettes(zones).agg(F.avg("silhouette")).first()[0] == pytest.approx(want, abs=1e-12)
    centres = [r.z for r in zones.orderBy(F.col("zone_id").cast("int")).limit(3).collect()]
    for row in nearest_centres(zones, centres).collect():
        away = [sum((a - b) ** 2 for a, b in zip(row.z, c, strict=True)) for c in centres]
        assert row.nearest_id == away.index(min(away)) and row.nearest_distance == pytest.approx(min(away))


def test_alone_in_a_cluster_scores_nothing(spark):
    frame = spark.createDataFrame([("a", 0, [0.0] * 8), ("b", 1, [1.0] * 8), ("c", 1, [1.0] * 8)], "zone_id string, segment_id int, z array<double>")
    assert {r.zone_id: r.silhouette for r in silhouettes(frame).collect()} == {"a": 0.0, "b": 1.0, "c": 1.0}
