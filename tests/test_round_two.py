"""Name order of zone inputs, score tolerance, explicit nulls, line checks, plans and failed runs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from curbflow import session
from curbflow.operators import audit as log
from curbflow.operators.diagnostics import daily_anomalies
from curbflow.operators.series import daily_service, zone_daily
from curbflow.operators.zone_features import zone_day
from curbflow.plans.pages import PAGES, page_query
from curbflow.plans.pipeline import LakePaths, run_full
from curbflow.sources.lake import EVENT_SCHEMA, read_audit_log


def test_zone_inputs_prefer_their_own_names(spark):
    both = spark.createDataFrame(
        [("2024-01-01", "2024-02-02", 5, 1.0, 9.0)],
        "date string, service_date string, zone_id int, pickup_count double, trips_total double",
    )
    row = zone_daily(both).first()
    assert (str(row.trip_date), row.trip_count) == ("2024-01-01", 1.0)
    service = daily_service(both.withColumn("service", F.lit("x"))).first()
    assert (str(service.trip_date), service.trip_count) == ("2024-02-02", 9.0)
    with pytest.raises(ValueError):
        zone_daily(spark.createDataFrame([("2024-01-01", 1, 2.0)], "date string, zone_id int, num_trips double"))


def test_zone_aggregates_hash_and_keep_the_largest_name(spark):
    rows = [("2024-01-01", 1, 2.0, "A"), ("2024-01-01", 1, 3.0, "B"), ("2024-01-02", 1, 4.0, None)]
    df = spark.createDataFrame(rows, "pickup_date string, zone_id int, trip_count double, zone_name string")
    got = {str(r.trip_date): (r.trip_count, r.zone_name) for r in zone_daily(df).collect()}
    assert got == {"2024-01-01": (5.0, "B"), "2024-01-02": (4.0, "B")}
    for frame in (zone_daily(df), zone_day(df)):
        assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_scores_on_both_sides_of_the_threshold(spark):
    days = [(i, 10.0) for i in range(10)] + [(10, 21.0)]
    df = spark.createDataFrame(
        [(f"2024-01-{i + 1:02d}", "yellow", 1, 1, t, 1.0) for i, t in days],
        "pickup_date string, service string, pickup_location_id int, pickup_day_of_week int, trip_count double, total_revenue double",
    )
    score = daily_anomalies(df).agg(F.max("demand_zscore")).first()[0]
    flagged = lambda threshold, digits: daily_anomalies(df, threshold, digits).where("is_anomaly").count()
    assert flagged(score - 1e-7, 9) == 1
    assert flagged(score + 1e-7, 9) == 0
    above = round(score, 6)  # rounds up: over the score, but not at six decimals
    assert above > score
    assert (flagged(above, 6), flagged(above, 9)) == (1, 0)


def test_explicit_null_wins_over_the_source_and_keys_are_sorted(spark):
    details = [
        '{"size_bytes": null, "source": {"size_bytes": 77}, "b": 1, "a": {"d": 1, "c": 2}}',
        '{"source": {"size_bytes": 77}, "metrics": {"z": 1, "a": null}}',
        "[1, 2]",
        None,
    ]
    events = spark.createDataFrame([(str(i), "t", "s", None, None, d) for i, d in enumerate(details)], EVENT_SCHEMA)
    got = {r.event_id: r for r in log.flatten_events(events).collect()}
    assert [got[str(i)].size_bytes for i in range(4)] == [None, 77, None, None]
    assert got["0"].details_json == '{"a":{"c":2,"d":1},"b":1,"size_bytes":null,"source":{"size_bytes":77}}'
    assert (got["0"].metrics_json, got["1"].metrics_json) == ("{}", '{"a":null,"z":1}')
    assert got["2"].details_json == got["3"].details_json == "{}"


def test_an_array_line_is_refused(spark, tmp_path):
    line = json.dumps({"event_id": "1", "event_type": "a", "status": "OK"})
    (tmp_path / "log.jsonl").write_text(f"{line}\n[{line},{line}]\n")
    with pytest.raises(Exception, match="(?i)not an object"):
        read_audit_log(spark, str(tmp_path / "log.jsonl")).collect()


def test_file_status_keeps_its_origin(spark):
    row = log.file_status("r", {"url": "https://x/yellow.parquet", "service": "yellow"}, "VALIDATED", size_bytes=5)
    details = json.loads(row[-1])
    assert (details["filename"], details["size_bytes"], details["sha256"]) == ("yellow.parquet", 5, None)
    assert details["source"]["service"] == "yellow"


def test_state_and_latest_need_no_sort_aggregate(spark):
    events = spark.createDataFrame([("1", "t", "s", None, "r", "{}")], EVENT_SCHEMA).withColumn("file_id", F.lit("f"))
    for frame in (log.latest_by(events, "file_id"), log.current_state(events, "file_id")):
        assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()
    assert log.current_state(events, "file_id").first().changes == 1


def test_a_failed_run_is_recorded(spark, tmp_path):
    lake = LakePaths(str(tmp_path / "lake"))
    (tmp_path / "bronze").mkdir()
    with pytest.raises(Exception):
        run_full(spark, str(tmp_path / "bronze"), lake, None, "r9")
    events = spark.read.schema(EVENT_SCHEMA).parquet(lake.layer("audit")).collect()
    assert {e.status for e in events} == {"STARTED", "FAILED"}
    assert "Error" in next(json.loads(e.details)["error"] for e in events if e.status == "FAILED")


def test_page_shows_its_model_figure(spark):
    star = spark.createDataFrame(
        [("yellow", "2024-01-01", 3.0, 5.0)],
        "service string, forecast_date string, forecast_trips double, forecast_upper_95 double",
    )
    metrics = spark.createDataFrame([("wmape_percent", 12.0)], "metric_name string, metric_value double")
    blocks = {r.block: r.first for r in page_query(star, PAGES["page_07"], model_metrics=metrics).collect()}
    assert blocks["model"] == pytest.approx(0.12)


def test_scratch_is_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", {})
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert session.clear_scratch(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
