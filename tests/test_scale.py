"""Properties that keep plans sound when data grows and one key owns a third of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from samples import ZONES

from curbflow.operators import marts
from curbflow.operators.diagnostics import daily_anomalies, demand_labels
from curbflow.operators.quality import invalid_only, silver_contract, valid_only
from curbflow.operators.reconcile import reconcile_counts, reconcile_total
from curbflow.operators.zones import enrich_trips
from curbflow.plans.dimensions import date_dimension, payment_dimension, service_dimension
from curbflow.plans.star import FACTS, star_join
from curbflow.sources.lake import read_zone_lookup
from curbflow.sources.sinks import path_exists, rebalanced, write_silver

ROWS = 90_000
DAYS = 3


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    """Trips of three days of which zone 10 owns a third, written as a Silver table."""
    rows = spark.range(ROWS, numPartitions=6).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 10 ELSE CAST(11 + id % 200 AS int) END AS pickup_location_id",
        "20 AS dropoff_location_id",
        f"timestamp_seconds(1672531200 + (id * 7919) % ({DAYS} * 86400)) AS pickup_datetime",
        "'yellow' AS service",
        "2023 AS year",
        "1 AS month",
        "CAST(1 + id % 6 AS int) AS payment_type",
        "10D AS total_amount",
        "id % 10 <> 9 AS dq_valid",
    )
    trips = rows.withColumn("dropoff_datetime", F.expr("pickup_datetime + INTERVAL 10 MINUTES"))
    path = str(tmp_path_factory.mktemp("silver") / "table")
    counts = write_silver(silver_contract(trips), path)
    assert counts == {"rows": ROWS, "valid_rows": ROWS * 9 // 10, "invalid_rows": ROWS // 10}
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def trips(spark, silver, tmp_path_factory):
    path = tmp_path_factory.mktemp("zones") / "zones.csv"
    lines = [",".join(map(str, row)) for row in ZONES]
    path.write_text("\n".join(["LocationID,Borough,Zone,service_zone", *lines]))
    return enrich_trips(valid_only(silver), read_zone_lookup(spark, str(path)))


def test_no_trip_is_lost_to_a_hot_zone(trips):
    daily = marts.daily_demand(trips)
    assert daily.agg(F.sum("trip_count")).first()[0] == ROWS * 9 // 10
    hot = daily.where("pickup_location_id = 10").agg(F.sum("trip_count"), F.count("*")).first()
    assert hot[0] == sum(1 for i in range(0, ROWS, 3) if i % 10 != 9) and hot[1] == DAYS


def test_window_partitions_are_bounded_by_the_calendar(trips):
    keys = ["service", "pickup_location_id"]
    hourly = marts.hourly_profile(trips)
    widest = hourly.groupBy(*keys).count().agg(F.max("count")).first()[0]
    assert widest <= 24 * DAYS
    assert demand_labels(hourly).count() == hourly.count()
    daily = marts.daily_demand(trips)
    assert daily_anomalies(daily).count() == daily.count()


def test_balance_holds_per_file_and_in_total(silver):
    per_file = reconcile_counts(silver, silver, invalid_only(silver))
    total = reconcile_total(per_file).first()
    assert total.reconciled and total.quarantine_rows == ROWS // 10
    short = reconcile_counts(silver, silver.where("id > 0"), invalid_only(silver))
    assert not reconcile_total(short).first().reconciled


def plan_of(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_mart_plans_prune_push_down_and_shuffle_once(trips):
    plan = plan_of(marts.service_financials(trips))
    assert "EqualTo(dq_valid,true)" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "dropoff_datetime" not in read and "trip_distance" not in read
    assert plan.count("Exchange hashpartitioning") <= 1
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SortAggregate"):
        assert bad not in plan


def test_star_joins_do_not_shuffle_the_fact(spark, trips):
    frames = {
        "date": date_dimension(spark),
        "service": service_dimension(spark),
        "payment": payment_dimension(spark),
    }
    fact = marts.service_financials(trips)
    plan = plan_of(star_join(fact, FACTS["finance"], frames))
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan


def test_rebalanced_writes_make_files_per_month_not_per_task(spark, tmp_path):
    scattered = spark.range(6000, numPartitions=12).selectExpr("id", "CAST(id % 3 AS int) AS month")
    path = tmp_path / "months"
    rebalanced(scattered, ("month",)).write.partitionBy("month").parquet(str(path))
    assert len(list(path.glob("month=*/part-*"))) <= 6
    assert spark.read.parquet(str(path)).count() == 6000
    assert path_exists(spark, str(path)) and not path_exists(spark, str(path / "none"))
