from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from samples import FAMILY_ROWS, MART_TRIPS, ZONE_SCHEMA, ZONES, write_month, yellow

from curbflow.operators import marts
from curbflow.operators.quality import valid_only
from curbflow.operators.zones import canonical_zones, enrich_trips
from curbflow.plans.pipeline import LakePaths, build_marts, build_silver
from curbflow.sources.lake import read_bronze, read_silver, read_zone_lookup
from curbflow.sources.sinks import write_csv


@pytest.fixture
def bronze(tmp_path):
    month = tmp_path / "bronze" / "trip_records" / "service=yellow" / "year=2023" / "month=01"
    write_month(
        month, "yellow", 2023, 1,
        [yellow(), yellow(PULocationID=999), yellow(tpep_dropoff_datetime=MART_TRIPS[0]["tpep_pickup_datetime"])],
    )
    (month / "README.parquet").write_bytes(b"PAR1 not a trip file PAR1")
    return tmp_path / "bronze"


def test_files_become_silver_and_quarantine_and_a_rerun_changes_nothing(spark, bronze, tmp_path):
    lake = LakePaths(str(tmp_path / "lake"))
    for _ in range(2):
        balance = build_silver(spark, str(bronze), lake).collect()
        assert [(r.source_rows, r.silver_rows, r.valid_rows, r.quarantine_rows) for r in balance] == [(3, 3, 1, 2)]
        assert balance[0].reconciled
    assert read_silver(spark, lake.layer("silver")).count() == 3


def test_a_repaired_month_leaves_quarantine(spark, bronze, tmp_path):
    lake = LakePaths(str(tmp_path / "lake"))
    write_month(bronze / "more", "green", 2023, 2, [{**FAMILY_ROWS["green"], "PUlocationID": 0}])
    build_silver(spark, str(bronze), lake)
    month = bronze / "trip_records" / "service=yellow" / "year=2023" / "month=01"
    write_month(month, "yellow", 2023, 1, [yellow(), yellow()])
    build_silver(spark, str(bronze), lake)
    left = spark.read.parquet(lake.layer("quarantine"))
    assert [r.service for r in left.select("service").distinct().collect()] == ["green"]
    assert not (tmp_path / "lake" / "quarantine" / "service=yellow" / "year=2023" / "month=1").exists()


def test_schema_drift_inside_a_family_is_read_in_groups(spark, tmp_path):
    write_month(tmp_path, "yellow", 2023, 1, [yellow(passenger_count=2.0)])
    write_month(tmp_path, "yellow", 2023, 2, [yellow(passenger_count=3)])
    renamed = {k.lower(): v for k, v in yellow(passenger_count=4).items()}
    write_month(tmp_path, "yellow", 2023, 3, [renamed])
    trips, inventory = read_bronze(spark, str(tmp_path))
    rows = {(r.month, r.passenger_count) for r in trips.select("month", "passenger_count").collect()}
    assert rows == {(1, 2), (2, 3), (3, 4)}
    assert inventory.count() == 3
    assert {r.source_file for r in trips.select("source_file").collect()} == {
        f"yellow_tripdata_2023-0{m}.parquet" for m in (1, 2, 3)
    }


def test_two_files_for_one_month_are_an_error(spark, tmp_path):
    write_month(tmp_path / "a", "yellow", 2023, 1, [yellow()])
    write_month(tmp_path / "b", "yellow", 2023, 1, [yellow()])
    with pytest.raises(ValueError, match="more than one file"):
        read_bronze(spark, str(tmp_path))


def test_nine_marts_from_four_trips(spark, tmp_path):
    bronze = tmp_path / "bronze"
    write_month(bronze, "yellow", 2023, 1, MART_TRIPS)
    lake = LakePaths(str(tmp_path / "lake"))
    build_silver(spark, str(bronze), lake)
    zones = spark.createDataFrame(ZONES, ZONE_SCHEMA)
    rows = build_marts(spark, lake, zones, anomaly_threshold=2.0)
    assert len(rows) == 10 and all(rows.values())
    daily = spark.read.parquet(lake.mart("daily"))
    assert daily.agg(F.sum("trip_count")).first()[0] == 3
    assert {r.pickup_borough for r in daily.collect()} == {"Manhattan", "Queens"}
    finance = spark.read.parquet(lake.mart("finance"))
    assert finance.agg(F.sum("trip_count"), F.sum("tipped_trips")).first()[:] == (3, 2)
    anomalies = spark.read.parquet(lake.mart("anomalies"))
    assert {"demand_zscore", "revenue_zscore", "is_anomaly", "anomaly_direction"} <= set(anomalies.columns)
    labels = spark.read.parquet(lake.mart("demand_labels_base"))
    assert {"demand_threshold", "previous_observed_trip_count", "label"} <= set(labels.columns)
    day = daily.where("pickup_location_id = 10").first()
    assert (day.trip_count, day.rush_hour_trips, day.night_trips, day.weekend_trips) == (2, 2, 0, 2)
    assert day.avg_speed_mph == pytest.approx(7.0 / (50 / 60))


def test_scoped_run_replaces_only_its_month(spark, tmp_path):
    bronze, lake = tmp_path / "bronze", LakePaths(str(tmp_path / "lake"))
    write_month(bronze, "yellow", 2023, 1, MART_TRIPS)
    later = MART_TRIPS[0]["tpep_pickup_datetime"].replace(month=2)
    february = yellow(tpep_pickup_datetime=later, tpep_dropoff_datetime=later.replace(hour=9))
    write_month(bronze, "yellow", 2023, 2, [february])
    build_silver(spark, str(bronze), lake)
    zones = spark.createDataFrame(ZONES, ZONE_SCHEMA)
    build_marts(spark, lake, zones)
    write_month(bronze, "yellow", 2023, 2, [february, february])
    build_silver(spark, str(bronze), lake)
    rows = build_marts(spark, lake, zones, year=2023, month=2)
    assert rows["daily"] == 1
    totals = spark.read.parquet(lake.mart("daily")).groupBy("pickup_month").sum("trip_count").collect()
    assert {tuple(r) for r in totals} == {(1, 3), (2, 2)}
    series = spark.read.parquet(lake.mart("timeseries_base"))
    assert series.agg(F.sum("trip_count")).first()[0] == 5


def test_partition_filter_prunes_files(spark, tmp_path):
    lake = LakePaths(str(tmp_path / "lake"))
    for m in (1, 2):
        write_month(tmp_path / "bronze", "yellow", 2023, m, [yellow()])
    build_silver(spark, str(tmp_path / "bronze"), lake)
    scoped = read_silver(spark, lake.layer("silver"), year=2023, month=2)
    assert scoped.count() == 1
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_zone_lookup_is_typed_deduplicated_and_strict(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text(
        'LocationID,Borough,Zone,service_zone\n1,EWR,"Newark, Airport",EWR\n2,Queens,Bay,Boro Zone\n'
        "2,Queens,Alley,Boro Zone\nx,None,None,None\n"
    )
    rows = {r.location_id: r.zone for r in read_zone_lookup(spark, str(path)).collect()}
    assert rows == {1: "Newark, Airport", 2: "Alley"}
    path.write_text("LocationID,Borough,Zone,service_zone\n1,A,B\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_zone_lookup(spark, str(path)).collect()
    with pytest.raises(ValueError, match="borough"):
        canonical_zones(spark.createDataFrame([(1,)], "LocationID int"))


def test_unknown_zones_are_kept_as_unknown(spark):
    zones = spark.createDataFrame(ZONES[:1], ZONE_SCHEMA)
    trips = spark.createDataFrame([(10, 77)], "pickup_location_id int, dropoff_location_id int")
    row = enrich_trips(trips, zones).first()
    assert (row.pickup_zone, row.dropoff_zone) == ("Central Harlem", "Unknown")


def test_marts_from_base_equal_marts_from_trips(spark, tmp_path):
    write_month(tmp_path / "bronze", "yellow", 2023, 1, MART_TRIPS)
    lake = LakePaths(str(tmp_path / "lake"))
    build_silver(spark, str(tmp_path / "bronze"), lake)
    zones = spark.createDataFrame(ZONES, ZONE_SCHEMA)
    trips = enrich_trips(valid_only(read_silver(spark, lake.layer("silver"))), zones)
    base = marts.trip_base(trips)
    for mart in (marts.DAILY_DEMAND, marts.HOURLY_PROFILE, marts.SERVICE_FINANCIALS, marts.TIP_FACTORS):
        direct, rolled = mart.build(trips), mart.build(base, from_base=True)
        assert direct.schema.names == rolled.schema.names
        assert direct.exceptAll(rolled).count() == 0 and rolled.exceptAll(direct).count() == 0


def test_csv_dataset_splits_by_rows_and_is_one_file_on_request(spark, tmp_path):
    frame = spark.range(10, numPartitions=2).selectExpr("id", "TIMESTAMP'2023-01-01 01:02:03' AS t")
    write_csv(frame, str(tmp_path / "many"), rows_per_file=3)
    assert len(list((tmp_path / "many").glob("part-*"))) == 4
    write_csv(frame, str(tmp_path / "one"), single_file=True)
    (only,) = (tmp_path / "one").glob("part-*")
    assert only.read_text().splitlines()[:2] == ["id,t", "0,2023-01-01 01:02:03"]
