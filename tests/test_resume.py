"""The ledger of done work, and a run that goes on where another stopped."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest

from curbflow.operators import audit
from curbflow.plans import resume
from curbflow.plans.pipeline import LakePaths
from curbflow.plans.resume import MONTH_LAYER, changed_files, lake_events, open_months, run_resumable, settled_files
from curbflow.workload.bronze_queries import bronze_files
from curbflow.workload.trips import zone_lookup

SF_DIR = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def flat(spark, *events):
    timed = [(f"e{i}", kind, status, START + timedelta(minutes=i), run, text) for i, (_, kind, status, _, run, text) in enumerate(events)]
    return audit.flatten_events(audit.events_frame(spark, timed))


def read(run, month, status="VALIDATED", sha="a"):
    name = f"green_tripdata_2023-{month:02d}.parquet"
    origin = {"filename": name, "service": "green", "year": 2023, "month": month}
    return audit.file_status(run, origin, status, size_bytes=10, sha256=sha)


def balanced(run, month):
    return audit.quality_result(run, "silver", "PASSED", service="green", year=2023, month=month)


def month_done(run, month):
    return audit.quality_result(run, MONTH_LAYER, "PASSED", year=2023, month=month)


def test_no_events_settle_nothing(spark, tmp_path):
    events = lake_events(spark, LakePaths(str(tmp_path)))
    assert settled_files(events).count() == open_months(events).count() == 0


def test_settled_are_files_whose_last_reading_balanced(spark):
    events = flat(
        spark,
        read("r1", 1), balanced("r1", 1), read("r2", 1, "SKIPPED"),  # stays settled
        read("r1", 2), balanced("r1", 2), read("r2", 2, sha="b"),  # read again, never balanced
        read("r1", 3), read("r2", 3, sha="c"), balanced("r2", 3),  # the second reading counts
        read("r1", 4), balanced("r2", 4),  # balanced by a run that did not read it
        read("r1", 5, "FAILED"), balanced("r1", 5),
        read("r1", 6, sha=None), balanced("r1", 6),
    )
    assert sorted((r.filename[-10:-8], r.sha256) for r in settled_files(events).collect()) == [("01", "a"), ("03", "c")]
    found = [("green_tripdata_2023-01.parquet", 10, "a"), ("green_tripdata_2023-03.parquet", 10, "a"),
             ("green_tripdata_2023-02.parquet", 10, "a"), ("green_tripdata_2023-01.parquet", 11, "a")]
    listed = spark.createDataFrame(found, "filename string, size long, sha256 string")
    assert {(r.filename[-10:-8], r.size): r.changed for r in changed_files(listed, events).collect()} == {
        ("01", 10): False, ("03", 10): True, ("02", 10): True, ("01", 11): True}


def test_months_are_open_until_marts_follow_silver(spark):
    events = flat(
        spark, balanced("r1", 1), month_done("r1", 1), balanced("r1", 2), balanced("r1", 3), month_done("r1", 3), balanced("r2", 3)
    )
    assert {r.month: r.open for r in open_months(events).collect()} == {1: False, 2: True, 3: True}


def test_a_run_goes_on_where_one_stopped(spark, tmp_path, monkeypatch):
    def stopped(*_, **__):
        raise RuntimeError("lost")

    lake, bronze, zones = LakePaths(str(tmp_path)), bronze_files(spark, SF_DIR), zone_lookup(spark, SF_DIR)
    with monkeypatch.context() as patched:
        patched.setattr(resume, "build_derived_marts", stopped)
        with pytest.raises(RuntimeError):
            run_resumable(spark, bronze, lake, zones, "r1", settings=None)
    rows = run_resumable(spark, bronze, lake, zones, "r2", settings=None).where("run_id = 'r2'").collect()
    seen = Counter((r.event_type, r.status, r.layer) for r in rows)
    skipped = seen.pop(("file_status", "SKIPPED", None))
    assert skipped > 10
    assert seen == {("pipeline_run", "STARTED", None): 1, ("pipeline_run", "SUCCEEDED", None): 1, ("quality_result", "PASSED", "gold"): 4}
    assert spark.read.parquet(lake.mart("anomalies")).count() == spark.read.parquet(lake.mart("daily")).count()
