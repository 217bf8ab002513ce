from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from samples import EXPECTED, FAMILY_ROWS, yellow

from curbflow.functions.naming import fold_name, physical_names
from curbflow.operators.canonical import canonical_trips
from curbflow.operators.quality import RULE_CODES, silver_contract, with_quality
from curbflow.settings import SERVICES, ModelSettings


def canonical(spark, service: str, *rows: dict) -> DataFrame:
    raw = spark.createDataFrame([dict(r) for r in rows])
    return with_quality(canonical_trips(raw, service=service, year=2023, month=1))


@pytest.mark.parametrize("service", SERVICES)
def test_each_family_reaches_the_canonical_trip(spark, service):
    row = canonical(spark, service, FAMILY_ROWS[service]).first()
    assert (row.trip_distance, row.total_amount) == EXPECTED[service]
    assert row.service == service
    assert row.cbd_congestion_fee is None
    assert row.dq_valid and row.dq_errors == [] and row.dq_error_count == 0
    assert row.trip_duration_minutes == 20.0
    assert len(row) == 56


def test_a_cast_that_fails_is_null_not_an_error(spark):
    bad = {**FAMILY_ROWS["fhvhv"], "trip_miles": "far", "passenger_count": "x"}
    row = canonical(spark, "fhvhv", bad).first()
    assert row.trip_distance is None and row.passenger_count is None
    assert row.dq_errors == ["TRIP_DISTANCE"]


def test_total_is_null_only_when_every_part_is(spark):
    bare = {k: v for k, v in FAMILY_ROWS["fhvhv"].items() if k not in ("base_passenger_fare", "tolls", "sales_tax", "tips")}
    row = canonical(spark, "fhvhv", bare).first()
    assert row.total_amount is None and "TOTAL_AMOUNT" in row.dq_errors
    paid = {**bare, "driver_pay": 9.0, "bcf": 1.5}
    assert canonical(spark, "fhvhv", paid).first().total_amount == 1.5


def test_rules_name_what_failed_in_order(spark):
    broken = yellow(
        tpep_pickup_datetime=None, PULocationID=999, trip_distance=900.0, total_amount=-20000.0
    )
    frame = spark.createDataFrame(
        [broken],
        "tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, PULocationID int, "
        "DOLocationID int, trip_distance double, total_amount double",
    )
    row = with_quality(canonical_trips(frame, service="yellow", year=2023, month=1)).first()
    assert row.dq_errors == [
        "PICKUP_DATETIME",
        "PICKUP_OUTSIDE_FILE_PERIOD",
        "TRIP_DURATION",
        "PICKUP_LOCATION",
        "TRIP_DISTANCE",
        "TOTAL_AMOUNT",
    ]
    assert row.dq_error_count == 6 and not row.dq_valid
    assert all(row[flag] is not None for flag in RULE_CODES)


def test_families_side_by_side_give_the_same_rows(spark):
    apart = [canonical(spark, s, FAMILY_ROWS[s]) for s in SERVICES]
    sides = []
    for service in SERVICES:
        raw = spark.createDataFrame([FAMILY_ROWS[service]])
        lowered = raw.selectExpr(f"'{service}' AS family", *(f"`{c}` AS {c.lower()}" for c in raw.columns))
        sides.append(lowered)
    mixed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    together = with_quality(
        canonical_trips(mixed, service_column="family", year=2023, month=1)
    )
    united = reduce(DataFrame.unionByName, apart)
    assert together.exceptAll(united.select(together.columns)).count() == 0
    assert together.count() == 4


def test_names_fold_and_first_physical_column_wins():
    assert fold_name("PU_Location ID") == "pulocationid"
    assert physical_names(["DropOff_datetime", "dropoff_datetime"], ["dropoff_datetime"]) == ["DropOff_datetime"]
    assert physical_names(["b", "a"], ["a", "b", "c"]) == ["a", "b"]


def test_contract_requires_and_completes(spark):
    silver = canonical(spark, "yellow", yellow())
    assert "mta_tax" in silver_contract(silver.drop("mta_tax")).columns
    with pytest.raises(ValueError, match="dq_valid"):
        silver_contract(silver.drop("dq_valid"))


def test_settings_refuse_nonsense():
    with pytest.raises(ValueError):
        ModelSettings(clusters=0)
    with pytest.raises(ValueError):
        ModelSettings(high_demand_quantile=1.0)
