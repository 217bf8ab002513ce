"""Readers and double publication over files written from the driver tables, bad lines among them."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import audit as log
from curbflow.plans.contracts import build_contract
from curbflow.session import scratch_path
from curbflow.sources import sinks
from curbflow.sources.lake import read_audit_csv, read_audit_log, read_zone_lookup
from curbflow.workload.lake_queries import detailed_events
from curbflow.workload.oracle_base import sql
from curbflow.workload.registry import query
from curbflow.workload.trips import audit_events, mart, table


def zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of the zone lookup: names with commas, ids twice and ids that are none."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nations.join(regions, nations.n_regionkey == regions.r_regionkey).selectExpr(
        "n_nationkey + 1 AS id", "r_name AS borough", "n_name || ', ' || lower(n_name) AS zone"
    )
    twice = rows.where("id % 5 = 0").selectExpr("id", "borough", "'Aa ' || zone AS zone")
    none = rows.where("id % 7 = 0").selectExpr("'N' || id AS id", "borough", "zone")
    typed = rows.unionByName(twice).select(F.col("id").cast("string").alias("id"), "borough", "zone").unionByName(none)
    return typed.select(F.format_string('%s,%s,"%s",%s', "id", "borough", "zone", "borough").alias("value"))


@query("zones_from_csv", """
SELECT CAST(n_nationkey + 1 AS INTEGER) AS location_id, r_name AS borough, r_name AS service_zone,
  least(z, CASE WHEN (n_nationkey + 1) % 5 = 0 THEN 'Aa ' || z ELSE z END) AS zone
FROM (SELECT *, n_name || ', ' || lower(n_name) AS z FROM nation) JOIN region ON n_regionkey = r_regionkey
""")
def zones_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup read back: typed, one row an id, the smallest names, quotes undone."""
    path = scratch_path(spark, "zones-csv")
    _headed(zone_lines(spark, sf_dir), "LocationID,Borough,Zone,service_zone", path)
    return read_zone_lookup(spark, path)


def _headed(lines: DataFrame, header: str, path: str) -> None:
    """Lines as text files of a folder, each with the header a CSV reader drops."""

    def with_header(batches):
        import pandas as pd

        first = True
        for batch in batches:
            yield pd.DataFrame({"value": [header, *batch["value"]]}) if first else batch
            first = False

    lines.coalesce(2).mapInPandas(with_header, "value string").write.text(path)


@query("audit_from_csv", sql("""
SELECT * FROM audit_contract
""", "audit_contract"))
def audit_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract D10 from the exported CSV instead of the event log: the same rows."""
    path = scratch_path(spark, "audit-export")
    sinks.export_events(log.flatten_events(detailed_events(spark, sf_dir)), path)
    return build_contract(read_audit_csv(spark, f"{path}/csv"), "D10_Auditoria")


@query("result_published_twice", sql("""
SELECT form, service, count(*) AS rows, sum(trip_count)::DOUBLE AS trips, count(DISTINCT pickup_date) AS days
FROM daily, (SELECT unnest(['csv', 'parquet']) AS form) GROUP BY ALL
""", "daily"))
def result_published_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table's Parquet and CSV forms, each read back."""
    path = scratch_path(spark, "published")
    sinks.write_result(mart(spark, sf_dir, "daily"), path)
    stored = spark.read.parquet(f"{path}/parquet")
    text = spark.read.schema(stored.schema).option("header", "true").option("escape", '"').csv(f"{path}/csv")
    forms = text.withColumn("form", F.lit("csv")).unionByName(stored.withColumn("form", F.lit("parquet")))
    return forms.groupBy("form", "service").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("trip_count").cast("double").alias("trips"),
        F.count_distinct("pickup_date").alias("days"),
    )


def refused(read: Callable[[], DataFrame]) -> bool:
    """Whether reading everything is an error of Spark's."""
    try:
        read().write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError):
        return True
    return False


@query("refused_lines", """
SELECT reader, lines, bad > 0 AS refused FROM (
  SELECT 'zone csv' AS reader, count(*) AS lines, 0 AS bad FROM nation UNION ALL
  SELECT 'zone csv, short line', count(*), 1 FROM nation UNION ALL
  SELECT 'audit json', count(*), 0 FROM events UNION ALL
  SELECT 'audit json, array', count(*), 1 FROM events UNION ALL
  SELECT 'audit json, cut line', count(*), 1 FROM events)
""")
def refused_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bad line among the good ones, and the whole read is refused."""
    nations = table(spark, sf_dir, "nation").selectExpr("concat(n_nationkey + 1, ',a,', n_name, ',b') AS value", "n_nationkey AS place")
    events = audit_events(spark, sf_dir)
    lines = events.select(F.to_json(F.struct(*events.columns)).alias("value"), F.col("event_id").cast("long").alias("place"))
    middle = {"nation": nations.agg(F.max("place")).first()[0], "events": lines.agg(F.max("place")).first()[0]}

    def spoilt(frame: DataFrame, last: int, change: str) -> DataFrame:
        return frame.selectExpr(f"CASE WHEN place = {last} THEN {change} ELSE value END AS value")

    cases = (
        ("zone csv", nations, middle["nation"], "value", True),
        ("zone csv, short line", nations, middle["nation"], "'7,b'", True),
        ("audit json", lines, middle["events"], "value", False),
        ("audit json, array", lines, middle["events"], "concat('[', value, ']')", False),
        ("audit json, cut line", lines, middle["events"], "left(value, length(value) - 3)", False),
    )
    found = []
    for name, frame, last, change, csv in cases:
        path = scratch_path(spark, "lines")
        if csv:
            _headed(spoilt(frame, last, change), "LocationID,Borough,Zone,service_zone", path)
        else:
            spoilt(frame, last, change).write.text(path)
        read = read_zone_lookup if csv else read_audit_log
        found.append((name, frame.count(), refused(lambda read=read, path=path: read(spark, path))))
    return spark.createDataFrame(found, "reader string, lines long, refused boolean")
