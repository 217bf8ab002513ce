from __future__ import annotations

from datetime import date

import pytest

from curbflow.plans.contracts import COLUMNS, CONTRACTS, build_contract
from curbflow.plans.dimensions import (
    cluster_dimension,
    date_dimension,
    hour_dimension,
    payment_dimension,
    service_dimension,
)
from curbflow.plans.measures import MEASURES, measure_by
from curbflow.plans.pages import PAGES, page_query
from curbflow.plans.star import FACTS, relationship_count, star_join


def test_the_model_has_its_shape():
    assert relationship_count() == 28
    assert len(FACTS) == 15
    assert sum(len(m) for m in MEASURES.values()) == 39
    assert len({m.label for ms in MEASURES.values() for m in ms}) == 39
    assert len(PAGES) == 10 and sum(len(p.slicers) for p in PAGES.values()) >= 20
    assert len(CONTRACTS) == 10


def test_dimensions(spark):
    days = {r.date: r for r in date_dimension(spark).collect()}
    assert len(days) == 1461
    first = days[date(2023, 1, 1)]
    assert (first.weekday_number, first.weekday_name, first.is_weekend) == (7, "domingo", True)
    assert (first.quarter, first.year_month, first.year_month_order) == ("T1", "2023-01", 202301)
    hours = {r.hour: (r.hour_band, r.is_rush_hour) for r in hour_dimension(spark).collect()}
    assert hours[5] == ("Madrugada", False) and hours[9] == ("Mañana", True) and hours[19] == ("Noche", True)
    assert service_dimension(spark).count() == 4 and payment_dimension(spark).count() == 6
    clusters = cluster_dimension(spark.createDataFrame([(1,), (1,), (0,)], "segment_id int"))
    assert {r.segment_name for r in clusters.collect()} == {"Segmento 0", "Segmento 1"}


def fact(spark):
    return spark.createDataFrame(
        [
            (date(2023, 1, 1), "yellow", 10, "Manhattan", 4, 40.0, 8.0),
            (date(2023, 1, 2), "yellow", 77, "Queens", 6, 30.0, 6.0),
            (date(2040, 1, 1), "green", 10, "Manhattan", 0, 0.0, 0.0),
        ],
        "pickup_date date, service string, pickup_location_id int, pickup_borough string, "
        "trip_count bigint, total_revenue double, distance_miles double",
    )


def star(spark):
    zones = spark.createDataFrame(
        [(10, "Manhattan", "Harlem", "Boro")], "location_id int, borough string, zone string, service_zone string"
    )
    frames = {"date": date_dimension(spark), "service": service_dimension(spark), "zone": zones}
    return star_join(fact(spark), FACTS["demand"], frames)


def test_star_keeps_unmatched_facts_under_a_null_member(spark):
    rows = {(r.pickup_date, r.date_year, r.origin_zone) for r in star(spark).collect()}
    assert rows == {
        (date(2023, 1, 1), 2023, "Harlem"),
        (date(2023, 1, 2), 2023, None),
        (date(2040, 1, 1), None, "Harlem"),
    }


def test_measures_are_ratios_of_sums_and_blank_on_zero(spark):
    rows = {r.service: r for r in measure_by(fact(spark), "demand", ["service"]).collect()}
    assert rows["yellow"].revenue_per_trip == 7.0 and rows["yellow"].avg_distance == 1.4
    assert rows["green"].revenue_per_trip is None


def test_route_weight_counts_trips_with_an_unknown_average(spark):
    frame = spark.createDataFrame(
        [(10, 12.0, None), (30, 20.0, 8.0)],
        "trip_count bigint, avg_trip_duration_minutes double, avg_speed_mph double",
    )
    row = measure_by(frame, "routes").first()
    assert row.weighted_speed == 6.0 and row.weighted_duration == 18.0


def test_page_blocks_order_and_slicers(spark):
    page = PAGES["page_01"]
    rows = page_query(star(spark), page).collect()
    total = [r for r in rows if r.block == "total"]
    assert [(r["first"], r["second"]) for r in total] == [(10.0, 70.0)]
    bars = [(r.category, r["first"]) for r in rows if r.block == "by_category"]
    assert bars == [("Queens", 6.0), ("Manhattan", 4.0)]
    trend = [r.date for r in rows if r.block == "trend"]
    assert trend == sorted(trend) and len(trend) == 3
    only = page_query(star(spark), page, {"date_year": [2023], "service_service_name": ["Yellow Taxi"]})
    assert [r["first"] for r in only.collect() if r.block == "by_series"] == [10.0]
    with pytest.raises(ValueError, match="no slicer"):
        page_query(star(spark), page, {"trip_count": [1]})


def test_page_of_no_rows_still_shows_totals(spark):
    """As GROUPING SETS (()) does in SQL: sums and ratios are null, counts are zero."""
    rows = page_query(star(spark), PAGES["page_01"], {"date_year": [1999]}).collect()
    assert [(r.block, r["first"], r["second"]) for r in rows] == [("total", None, None)]
    cases = spark.sql("SELECT 'temporal_test' AS dataset_split, DATE'2023-01-02' AS prediction_date, 1 AS actual_high_demand, 0 AS predicted_high_demand")
    rows = page_query(cases, PAGES["page_09"], {"predicted_high_demand": [1]}).collect()
    assert [(r.block, r["first"], r["second"]) for r in rows] == [("total", None, 0.0)]


@pytest.fixture(scope="module")
def wide(spark):
    """One row carrying every column any contract asks for."""
    return spark.sql(
        """SELECT DATE'2023-01-02' AS pickup_date, 2023 AS pickup_year, 1 AS pickup_month, 8 AS pickup_hour,
        'yellow' AS service, 'Manhattan' AS pickup_borough, 'Harlem' AS pickup_zone, 'JFK' AS dropoff_zone,
        1 AS payment_type, 5L AS trip_count, 50D AS total_revenue, 5D AS tip_revenue, 7D AS avg_speed_mph,
        12D AS avg_trip_duration_minutes, 3.5D AS demand_zscore, 0.5D AS revenue_zscore, true AS is_anomaly,
        'HIGH' AS anomaly_direction, 0.1D AS aggregate_tip_rate, 0.4D AS tipped_trip_share,
        DATE'2023-02-03' AS forecast_date, 9D AS forecast_trips, 11D AS forecast_upper_95,
        'Alta demanda' AS segment_label, 99D AS total_trips, DATE'2023-01-09' AS prediction_date,
        0.7D AS probability_high_demand, 8D AS actual_trips, 1 AS actual_high_demand, 0 AS predicted_high_demand,
        'e1' AS event_id, 'file_status' AS event_type, 'VALIDATED' AS status, '2023-03-04T05:06:07' AS timestamp_utc,
        123L AS size_bytes"""
    )


@pytest.mark.parametrize("name", CONTRACTS)
def test_every_contract_has_eleven_columns(wide, name):
    frame = build_contract(wide, name)
    assert tuple(frame.columns) == COLUMNS and frame.count() == 1


def test_contract_values(wide):
    rows = {name: build_contract(wide, name).first() for name in CONTRACTS}
    assert (rows["D04_Causas"].status, rows["D04_Causas"].series) == ("ANOMALÍA", "HIGH")
    assert (rows["D05_Rutas"].status, rows["D05_Rutas"].category) == ("LENTA", "Harlem → JFK")
    assert rows["D03_Ingresos"].date == "2023-01-01"
    assert rows["D07_Pronostico"][:4] == ("2023-02-03", 2023, 1, "yellow")
    assert (rows["D08_Segmentacion"].date, rows["D08_Segmentacion"].metric_aux) == ("Periodo completo", 50.0)
    assert (rows["D09_Clasificacion"].series, rows["D09_Clasificacion"].status) == ("Normal", "ERROR")
    assert (rows["D10_Auditoria"].metric_value, rows["D10_Auditoria"].metric_aux) == (1.0, 123.0)


def test_contract_defaults_for_absent_columns(spark):
    bare = spark.createDataFrame([(None,)], "x string")
    day = build_contract(bare, "D01_Resumen").first()
    assert (day.date, day.service, day.category, day.series) == ("Sin fecha", "all", "NYC", "Total")
    assert (day.metric_value, day.metric_aux) == (0.0, 0.0)
    assert build_contract(bare, "D05_Rutas").first().status == "NORMAL"
