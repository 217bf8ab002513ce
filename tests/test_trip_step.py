"""The step that all trip queries share: what is shuffled and read for Silver and the monthly files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from curbflow.plans.pipeline import LakePaths, build_silver
from curbflow.sources import sinks
from curbflow.workload import bronze_queries, trips

SF_DIR = "/root/testdata/sf0.001"


def test_lines_are_shuffled_narrow_and_for_their_order_alone(spark):
    plan = trips.scored_trips(spark, SF_DIR, *trips.GATHERED)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions", 1)
    assert "pickup_datetime" in above and "pickup_datetime" not in below and "format_string" not in below
    joins = re.findall(r"Join Inner, .*", below)
    assert ["o_custkey" in j for j in joins] == [False, False, True]  # customers meet orders, below the lines


def test_rows_come_gathered_and_are_the_same(spark):
    plain, gathered = (trips.trip_facts(spark, SF_DIR, *keys) for keys in ((), trips.GATHERED))
    assert plain.exceptAll(gathered).isEmpty() and gathered.exceptAll(plain).isEmpty()


def test_zones_are_read_from_a_table_of_known_size(spark):
    assert trips.zone_lookup(spark, SF_DIR).inputFiles()


def test_a_monthly_file_is_written_from_its_own_folder(spark):
    files = trips.family_files(spark, SF_DIR).where("family = 'green' AND file_month = 3")
    scan = files._jdf.queryExecution().executedPlan().toString()
    assert "file_month" in scan.split("PartitionFilters: ", 1)[1].split("PushedFilters", 1)[0]
    folder = bronze_queries.bronze_files(spark, SF_DIR)
    rows = spark.read.parquet(f"{folder}/green_tripdata_2023-03.parquet").agg(F.count(F.lit(1))).first()[0]
    assert rows == files.count() > 0


def test_silver_is_written_without_sorting_its_months(spark, tmp_path, monkeypatch):
    """Six months in one task, more than stay open: none is lost, and the setting is as it was."""
    name, seen, plain = "spark.sql.maxConcurrentOutputFileWriters", [], sinks._overwrite_partitions

    def spied(*args):
        seen.append(spark.conf.get(name))
        plain(*args)

    monkeypatch.setattr(sinks, "_overwrite_partitions", spied)
    before = spark.conf.get(name)
    rows = spark.range(60, numPartitions=1).selectExpr("id", "id % 5 > 0 AS dq_valid", "'green' AS service", "2023 AS year", "id % 6 + 1 AS month")
    counts = sinks.write_silver(rows, str(tmp_path / "silver"))
    assert counts == {"rows": 60, "valid_rows": 48, "invalid_rows": 12}
    assert seen == ["4"] and spark.conf.get(name) == before
    back = spark.read.parquet(str(tmp_path / "silver")).groupBy("month").count().collect()
    assert {r.month: r["count"] for r in back} == dict.fromkeys(range(1, 7), 10)


def test_a_layer_is_written_without_sorting_its_partitions(spark, tmp_path, monkeypatch):
    name, seen, plain = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet

    def spied(self, *args):
        seen.append(spark.conf.get(name))
        plain(self, *args)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    before = spark.conf.get(name)
    rows = spark.range(60, numPartitions=1).selectExpr("id", "id % 6 + 1 AS month")
    back = trips.written(spark, str(tmp_path), "months", lambda: rows, "month", gathered=True)
    assert seen == ["4"] and spark.conf.get(name) == before
    assert {r.month: r["count"] for r in back.groupBy("month").count().collect()} == dict.fromkeys(range(1, 7), 10)


def test_a_balance_is_counted_once(spark, tmp_path):
    """It stands without another look at the files, Silver and quarantine it was counted from."""
    lake = LakePaths(str(tmp_path / "lake"))
    balance = build_silver(spark, bronze_queries.bronze_files(spark, SF_DIR), lake)
    assert balance.inputFiles() == []
    assert balance.agg(F.sum("source_rows")).first()[0] == trips.trip_facts(spark, SF_DIR).count()
