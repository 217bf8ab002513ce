"""The source side of the reconciliation queries is a scan of the monthly files."""

from __future__ import annotations

from curbflow.sources.lake import read_silver
from curbflow.workload import bronze_queries

SF_DIR = "/root/testdata/sf0.001"


def test_lost_rows_are_counted_from_the_files(spark):
    plan = bronze_queries.bronze_lost_rows(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Generate" not in plan


def test_verification_sees_rows_lost_before_silver(spark, monkeypatch):
    """Valid rows of one file are missing from Silver: two files are off, not only the planted one."""

    def leaky(*args, **kwargs):
        return read_silver(*args, **kwargs).where("NOT (dq_valid AND service = 'yellow' AND month = 1)")

    monkeypatch.setattr(bronze_queries, "read_silver", leaky)
    found = {r.check: r.violations for r in bronze_queries.verification_run(spark, SF_DIR).collect()}
    assert found["reconciliation"] == 2
