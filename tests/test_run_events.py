"""A run leaves its events as it goes, also when it ends without an end."""

from __future__ import annotations

import pytest

from curbflow.plans import pipeline
from curbflow.plans.pipeline import LakePaths, run_full
from curbflow.sources.lake import EVENT_SCHEMA
from curbflow.workload.bronze_queries import bronze_files
from curbflow.workload.trips import zone_lookup

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("stop", "ends"), [(KeyboardInterrupt, []), (RuntimeError, ["FAILED"])])
def test_events_up_to_the_stage_that_stops(spark, tmp_path, monkeypatch, stop, ends):
    def stopped(*_):
        raise stop("no marts")

    monkeypatch.setattr(pipeline, "build_marts", stopped)
    lake, bronze = LakePaths(str(tmp_path)), bronze_files(spark, SF_DIR)
    with pytest.raises(stop):
        run_full(spark, bronze, lake, zone_lookup(spark, SF_DIR), "r1", settings=None)
    rows = spark.read.schema(EVENT_SCHEMA).parquet(lake.layer("audit")).collect()
    assert [r.status for r in rows if r.event_type == "pipeline_run" and r.status != "STARTED"] == ends
    assert sum(r.status == "STARTED" for r in rows) == 1
    files = [r for r in rows if r.event_type == "file_status"]
    assert len(files) == len([r for r in rows if r.event_type == "quality_result"]) > 10


def test_a_run_that_never_read_a_file_has_started(spark, tmp_path, monkeypatch):
    def killed(*_):
        raise SystemExit

    monkeypatch.setattr(pipeline, "list_files", killed)
    with pytest.raises(SystemExit):
        run_full(spark, "nowhere", LakePaths(str(tmp_path)), zone_lookup(spark, SF_DIR), "r1", settings=None)
    rows = spark.read.schema(EVENT_SCHEMA).parquet(LakePaths(str(tmp_path)).layer("audit")).collect()
    assert [r.status for r in rows] == ["STARTED"]
