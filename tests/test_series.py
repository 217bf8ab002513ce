from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import DAILY_SCHEMA, ZONE_SERIES_SCHEMA, daily_series, zone_series

from curbflow.operators import series
from curbflow.operators.diagnostics import daily_anomalies, demand_labels
from curbflow.operators.zone_features import ZONE_FEATURES, zone_features


@pytest.fixture(scope="module")
def panel(spark):
    rows = [r for r in daily_series(60) if not (r[1] == "green" and r[0].day == 7)]
    rows = [r for r in rows if not (r[1] == "green" and r[0] < date(2023, 1, 5))]
    daily = series.daily_service(spark.createDataFrame(rows, DAILY_SCHEMA))
    return series.complete_panel(daily, entity="service_type").cache()


def test_panel_has_no_gaps_and_starts_with_its_own_entity(panel):
    frame = panel.toPandas()
    for _, group in frame.groupby("service_type"):
        days = sorted(group["trip_date"])
        assert days == [days[0] + timedelta(days=i) for i in range(len(days))]
    green = frame[frame.service_type == "green"]
    assert min(green.trip_date) == date(2023, 1, 5)
    assert (green[green.trip_date.map(lambda d: d.day == 7)].trip_count == 0).all()


def test_features_equal_brute_force(panel):
    got = series.time_features(panel, entity="service_type").toPandas()
    for _, group in got.groupby("service_type"):
        group = group.sort_values("trip_date").reset_index(drop=True)
        values = group["trip_count"]
        for k in series.LAGS:
            pd.testing.assert_series_equal(group[f"lag_{k}"], values.shift(k), check_names=False)
        for k in series.ROLLING:
            expected = values.shift(1).rolling(k, min_periods=1).mean()
            pd.testing.assert_series_equal(group[f"rolling_mean_{k}"], expected, check_names=False)
        assert list(group["trend_days"]) == [float(i) for i in range(len(group))]


def test_a_day_never_sees_its_own_or_later_values(spark, panel):
    changed = panel.withColumn(
        "trip_count", F.expr("CASE WHEN trip_date >= DATE'2023-02-10' THEN 1e9 ELSE trip_count END")
    )
    keys = ["service_type", "trip_date", *series.TIME_FEATURES]
    before = series.time_features(panel, entity="service_type").select(keys)
    after = series.time_features(changed, entity="service_type").select(keys)
    until = "trip_date <= DATE'2023-02-10'"
    assert before.where(until).exceptAll(after.where(until)).count() == 0


def test_split_is_relative_to_each_entity(panel):
    tagged = series.tag_split(panel, entity="service_type", test_days=10)
    per = tagged.groupBy("service_type", "split").count().collect()
    assert {(r.service_type, r["count"]) for r in per if r.split == "test"} == {("green", 10), ("yellow", 10)}


def test_absent_and_null_services(spark):
    rows = [(date(2023, 1, 1), None, 2.0), (date(2023, 1, 1), "a", 3.0), (date(2023, 1, 1), "a", -1.0)]
    frame = spark.createDataFrame(rows, DAILY_SCHEMA)
    got = {(r.service_type, r.trip_count) for r in series.daily_service(frame).collect()}
    assert got == {("UNKNOWN", 2.0), ("a", 3.0)}
    alone = series.daily_service(frame.drop("service")).collect()
    assert [(r.service_type, r.trip_count) for r in alone] == [("ALL", 5.0)]


def test_zone_features_consolidate_services_before_daily_statistics(spark):
    frame = spark.createDataFrame(zone_series(30, 3), ZONE_SERIES_SCHEMA)
    got = {r.zone_id: r for r in zone_features(frame).collect()}
    local = frame.toPandas()
    for zone, rows in local.groupby("pickup_location_id"):
        days = rows.groupby("pickup_date")["trip_count"].sum()
        row = got[str(zone)]
        assert row.active_days == 30.0
        assert row.avg_daily_trips == pytest.approx(days.mean())
        assert row.demand_stddev == pytest.approx(days.std(ddof=0))
        weighted = (rows.avg_trip_distance * rows.trip_count).sum() / rows.trip_count.sum()
        assert row.avg_trip_distance == pytest.approx(weighted)
        assert all(row[n] is not None for n in ZONE_FEATURES)


def test_zone_features_fall_back_without_dates_or_revenue(spark):
    frame = spark.createDataFrame([("1", 4.0, 2.0), ("1", 6.0, None)], "zone_id string, trips double, avg_fare double")
    row = zone_features(frame).first()
    assert (row.active_days, row.total_revenue, row.avg_fare_amount) == (2.0, 8.0, 2.0)


def test_revenue_only_anomaly_reads_normal(spark):
    rows = [(date(2023, 1, 1) + timedelta(days=7 * i), "y", 1, 1, 5, 100.0) for i in range(20)]
    rows[-1] = (*rows[-1][:5], 9000.0)
    frame = spark.createDataFrame(
        rows,
        "pickup_date date, service string, pickup_location_id int, pickup_day_of_week int, "
        "trip_count bigint, total_revenue double",
    )
    flagged = daily_anomalies(frame).where("is_anomaly").collect()
    assert [(r.total_revenue, r.anomaly_direction, r.demand_zscore) for r in flagged] == [(9000.0, "NORMAL", 0.0)]


def test_label_lag_is_the_previous_observed_hour(spark):
    rows = [(date(2023, 1, 1), 3, 10), (date(2023, 1, 1), 9, 20), (date(2023, 1, 2), 1, 30)]
    frame = spark.createDataFrame(rows, "pickup_date date, pickup_hour int, trip_count bigint").selectExpr(
        "*", "'y' AS service", "1 AS pickup_location_id", "dayofweek(pickup_date) AS pickup_day_of_week"
    )
    got = demand_labels(frame).orderBy("pickup_date", "pickup_hour").collect()
    assert [r.previous_observed_trip_count for r in got] == [None, 10.0, 20.0]
    assert [r.label for r in got] == [0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        demand_labels(frame, quantile=0.0)


def test_errors_and_weights(spark):
    frame = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0), (0.0, 1.0)], "trip_count double, prediction double")
    row = series.forecast_errors(frame).first()
    assert row.rmse == pytest.approx((9 / 3) ** 0.5)
    assert row.mape_percent == pytest.approx(15.0) and row.wmape_percent == pytest.approx(100 * 5 / 30)
    assert row.r2 == pytest.approx(1 - 9 / 200)
    labelled = spark.createDataFrame([(1.0,), (0.0,), (0.0,), (0.0,)], "label double")
    assert {(r.label, r.class_weight) for r in series.class_weights(labelled).collect()} == {(0, 4 / 6), (1, 2.0)}
    assert [r.label for r in series.class_weights(labelled.where("label = 0")).collect()] == [0]
