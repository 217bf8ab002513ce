"""Files, links, sinks, audit and verification queries over data derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import audit as log
from curbflow.operators.quality import invalid_only
from curbflow.operators.reconcile import reconcile_counts
from curbflow.plans.contracts import CONTRACTS, build_contract
from curbflow.plans.measures import measure_by
from curbflow.plans.pages import PAGES, page_query
from curbflow.plans.verification import metric_bounds, verify_lake
from curbflow.session import scratch_path
from curbflow.settings import SourceScope
from curbflow.sources import catalog, files, links, sinks
from curbflow.sources.lake import EVENT_SCHEMA, read_audit_log
from curbflow.workload.model_queries import metrics, result
from curbflow.workload.oracle_base import block, sql
from curbflow.workload.registry import query, stamp, stamp_sql
from curbflow.workload.semantic_queries import (
    contract_sql,
    fact_rows,
    page_sql,
)
from curbflow.workload.trips import (
    audit_events,
    mart,
    silver_trips,
    table,
    trip_facts,
    zone_lookup,
)

SCOPE = SourceScope()
BASE_URL = SCOPE.base_url


# --- the grid of files ----------------------------------------------------------------------

block("grid", body=f"""
SELECT service, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month,
  service || '_tripdata_' || year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '.parquet' AS filename,
  '{BASE_URL}/' || service || '_tripdata_' || year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '.parquet' AS url
FROM (VALUES ('yellow'), ('green'), ('fhv'), ('fhvhv')) s(service),
  (VALUES (2023), (2024), (2025), (2026)) y(year), (SELECT unnest(range(1, 13)) AS month)
""")


@query("expected_catalog", sql("""
SELECT g.service, g.year, g.month, g.filename, g.url, CAST(coalesce(s.trips, 0) AS BIGINT) AS trips
FROM grid g LEFT JOIN (SELECT service, year, month, count(*) AS trips FROM silver GROUP BY ALL) s USING (service, year, month)
""", "grid", "silver"))
def expected_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grid with the trips each file actually brought."""
    brought = (
        silver_trips(spark, sf_dir)
        .groupBy("service", "year", "month")
        .agg(F.count(F.lit(1)).alias("trips"))
    )
    grid = catalog.expected_files(spark, SCOPE).drop("service_rank")
    joined = grid.join(brought, ["service", "year", "month"], "left")
    return joined.withColumn("trips", F.coalesce("trips", F.lit(0)))


@query("missing_files", sql("""
SELECT service, year, month, filename FROM grid g
WHERE year < 2026 AND NOT EXISTS (SELECT 1 FROM silver s WHERE s.service = g.service AND s.year = g.year AND s.month = g.month)
""", "grid", "silver"))
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = catalog.expected_files(spark, SCOPE)
    observed = silver_trips(spark, sf_dir)
    absent = catalog.missing_files(grid, observed, SCOPE.historical_years)
    return absent.select("service", "year", "month", "filename")


@query("catalog_completeness", sql("""
SELECT service, count(*) AS expected_files, count(s.n) AS present_files, count(*) - count(s.n) AS missing_files
FROM grid g LEFT JOIN (SELECT service, year, month, count(*) AS n FROM silver GROUP BY ALL) s USING (service, year, month)
WHERE year < 2026 GROUP BY service
""", "grid", "silver"))
def catalog_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = catalog.expected_files(spark, SCOPE)
    return catalog.completeness(grid, silver_trips(spark, sf_dir), SCOPE.historical_years)


@query("file_inventory", sql("""
SELECT service, year, month, source_file AS filename, count(*) AS length FROM canonical GROUP BY ALL
""", "canonical"))
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly files recognised by name among the lake's paths; foreign names are left out."""
    by_file = (
        silver_trips(spark, sf_dir).groupBy("source_file").agg(F.count(F.lit(1)).alias("length"))
    )
    named = by_file.selectExpr("concat('lake:/trips/', source_file) AS path", "length")
    foreign = by_file.selectExpr("concat('lake:/trips/x_', source_file) AS path", "length")
    return files.file_inventory(named.unionByName(foreign)).drop("path")


@query("file_counts", sql("""
SELECT service, year, count(DISTINCT source_file) AS files FROM canonical GROUP BY ALL
""", "canonical"))
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per service and year."""
    named = silver_trips(spark, sf_dir).withColumnRenamed("source_file", "filename")
    return log.files_by(named, "service", "year")


@query("file_integrity")
def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, magic and SHA-256 of the given tables' own files."""
    checked = files.file_integrity(files.list_files(spark, sf_dir, "*.parquet"))
    return checked.selectExpr(
        "regexp_extract(path, '[^/]+$', 0) AS filename", "size", "sha256", "parquet_magic"
    )


_MANIFEST_SQL = """
SELECT url, CASE
  WHEN id % 13 = 1 THEN 'PARQUET_MAGIC' WHEN id % 17 = 2 THEN 'SIDECAR_ABSENT' WHEN id % 19 = 3 THEN 'SIDECAR_LENGTH'
  WHEN id % 23 = 4 THEN 'SIZE' WHEN id % 29 = 5 THEN 'SIDECAR_SHA256' WHEN id % 31 = 6 THEN 'CHECKSUM'
  WHEN id % 11 = 7 THEN 'MANIFEST_ABSENT' WHEN id % 7 = 5 THEN 'MANIFEST_STATUS' ELSE 'OK' END AS verdict
FROM (SELECT page_id AS id, url || '#' || page_id AS url FROM pages)
"""


@query("manifest_reconcile", _MANIFEST_SQL)
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored files, with faults planted in their sidecars and manifest entries."""
    stored = table(spark, sf_dir, "pages").selectExpr(
        "page_id AS id",
        "concat(url, '#', page_id) AS url",
        "CAST(octet_length(html) AS bigint) AS size",
        "sha2(html, 256) AS sha256",
        "page_id % 13 <> 1 AS parquet_magic",
    )
    sidecars = stored.where("id % 17 <> 2").selectExpr(
        "url",
        "CASE WHEN id % 23 = 4 THEN size + 1 ELSE size END AS size_bytes",
        "CASE WHEN id % 19 = 3 THEN 0 WHEN id % 23 = 4 THEN size + 1 ELSE size END AS content_length",
        "CASE WHEN id % 29 = 5 THEN 'none' WHEN id % 31 = 6 THEN sha2(url, 256) ELSE sha256 END AS sha256",
        "CAST(NULL AS string) AS etag",
    )
    manifest = stored.where("id % 11 <> 7").selectExpr(
        "url",
        "size AS size_bytes",
        "sha256",
        "CASE WHEN id % 7 = 5 THEN 'FAILED' ELSE 'VALIDATED' END AS status",
        "CAST(NULL AS string) AS etag",
    )
    return files.reconcile_manifest(stored, sidecars, manifest)


@query("ingest_summary", """
SELECT count(*) AS downloads, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id END) AS BIGINT) AS downloaded_bytes,
  count(*) FILTER (WHERE user_id % 3 = 0) AS skipped
FROM events
""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN user_id % 3 = 0 THEN 'SKIPPED' ELSE 'VALIDATED' END AS status",
        "CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id END AS transferred_bytes",
    )
    return files.ingest_summary(manifest)


# --- published links ------------------------------------------------------------------------

block("raw_links", body=r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
  trim(replace(unnest(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
    '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"', 1)), '&amp;', '&')) AS href
FROM pages
""")
block("all_links", "raw_links", body="""
SELECT page_id, href, origin || href AS url, url_decode(regexp_extract(href, '([^/]*)$', 1)) AS filename
FROM raw_links WHERE href <> ''
""")


@query("page_links", sql(
    "SELECT url, filename, count(*) AS anchors, count(DISTINCT page_id) AS pages FROM all_links GROUP BY ALL",
    "all_links"))
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.page_links(table(spark, sf_dir, "pages"))
    return found.groupBy("url", "filename").agg(
        F.count(F.lit(1)).alias("anchors"), F.count_distinct("page_id").alias("pages")
    )


@query("link_conflicts", sql(
    "SELECT filename, count(DISTINCT url) AS urls FROM all_links GROUP BY 1 HAVING count(DISTINCT url) > 1",
    "all_links"))
def link_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_conflicts(links.page_links(table(spark, sf_dir, "pages")))


# --- sinks ----------------------------------------------------------------------------------


@query("silver_rerun_idempotent", sql("""
SELECT service, year, month, count(*) AS rows, count(*) FILTER (WHERE dq_valid) AS valid_rows
FROM silver GROUP BY ALL
""", "silver"))
def silver_rerun_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writing every month twice leaves each once."""
    path = scratch_path(spark, "rerun")
    silver = silver_trips(spark, sf_dir)
    for _ in range(2):
        sinks.write_silver(silver, path)
    return (
        spark.read.parquet(path)
        .groupBy("service", "year", "month")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("dq_valid").alias("valid_rows"))
    )


@query("quarantine_write", sql("""
SELECT service, year, month, count(*) AS rows FROM silver WHERE NOT dq_valid AND month <> 4 GROUP BY ALL
""", "silver"))
def quarantine_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month that no longer has invalid rows loses its stale quarantine partition."""
    path = scratch_path(spark, "quarantine")
    silver = silver_trips(spark, sf_dir)
    sinks.write_quarantine(silver, path)
    repaired = silver.withColumn("dq_valid", F.col("dq_valid") | (F.col("month") == 4))
    sinks.write_quarantine(repaired, path)
    return (
        spark.read.parquet(path)
        .groupBy("service", "year", "month")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query("gold_incremental_month", sql("""
SELECT pickup_year, pickup_month, service, CAST(sum(trip_count * CASE WHEN pickup_month = 2 THEN 2 ELSE 1 END) AS BIGINT) AS trips
FROM finance GROUP BY ALL
""", "finance"))
def gold_incremental_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriting one month of a mart replaces that month and leaves the others alone."""
    path = scratch_path(spark, "finance")
    finance = mart(spark, sf_dir, "finance")
    sinks.write_mart(finance, path)
    february = finance.where("pickup_month = 2").withColumn("trip_count", F.col("trip_count") * 2)
    sinks.write_mart(february, path, year=2023, month=2)
    return (
        spark.read.parquet(path)
        .groupBy("pickup_year", "pickup_month", "service")
        .agg(F.sum("trip_count").alias("trips"))
    )


@query("contract_csv_roundtrip", sql(contract_sql(
    "finance", date="strftime(make_date(pickup_year, pickup_month, 1), '%Y-%m-%d')", year="pickup_year",
    month="pickup_month", service="service", category="CAST(payment_type AS VARCHAR)", series="service",
    metric_name="'Ingresos y propinas'", metric_value="total_revenue", metric_aux="tip_revenue",
    status="'OK'", detail="'Composición financiera por servicio y pago'"), "finance"))
def contract_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract written as a CSV dataset and read back unchanged."""
    path = scratch_path(spark, "contract")
    frame = build_contract(mart(spark, sf_dir, "finance"), "D03_Ingresos")
    sinks.write_csv(frame, path)
    return spark.read.schema(frame.schema).option("header", "true").csv(path)


# --- audit ----------------------------------------------------------------------------------


@query("audit_events_scan", sql(f"""
SELECT event_id, event_type, status, run_id, details, {stamp_sql("timestamp_utc")} FROM audit
""", "audit"))
def audit_events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and scanned back under a fixed schema, failing fast."""
    path = scratch_path(spark, "audit-log")
    audit_events(spark, sf_dir).write.json(path)
    events = read_audit_log(spark, path)
    return events.select(
        "event_id", "event_type", "status", "run_id", "details", stamp("timestamp_utc")
    )


@query("audit_append", sql("""
SELECT event_type, count(*) * 2 AS events, count(DISTINCT event_id) AS ids FROM audit GROUP BY 1
UNION ALL SELECT 'pipeline_run', 2, 2
""", "audit"))
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending never replaces: two batches and a run's own events all remain."""
    path = scratch_path(spark, "audit-table")
    for _ in range(2):
        sinks.append_events(audit_events(spark, sf_dir), path)
    run = [log.run_started("r1", "full"), log.run_finished("r1", rows=1)]
    sinks.append_events(log.events_frame(spark, run), path)
    return (
        spark.read.schema(EVENT_SCHEMA)
        .parquet(path)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))
    )


def detailed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events with own fields, source fields and metrics, keys in no order. A size is given,
    given as null, or absent; only an absent one is taken from the source."""
    k = F.from_json("details", "k int")["k"]
    return audit_events(spark, sf_dir).withColumn("k", k).selectExpr(
        "event_id", "event_type", "status", "timestamp_utc", "run_id",
        """concat('{"source_rows":', k * 7,
          CASE k % 4 WHEN 1 THEN ',"size_bytes":null' WHEN 3 THEN '' ELSE concat(',"size_bytes":', k * 1000) END,
          CASE WHEN k % 3 = 0 THEN ',"layer":"silver"' ELSE '' END,
          ',"metrics":{"k":', k, ',"a":1},"source":{"service":"s', run_id, '","year":2024,"size_bytes":', k * 5,
          ',"filename":"', event_type, '.parquet"}}') AS details""",
    )


block("flat", "audit", body="""
SELECT event_id, event_type, status, timestamp_utc, run_id, event_type || '.parquet' AS filename, 's' || run_id AS service,
  2024 AS year, CAST(CASE k % 4 WHEN 1 THEN NULL WHEN 3 THEN k * 5 ELSE k * 1000 END AS BIGINT) AS size_bytes,
  CASE WHEN k % 3 = 0 THEN 'silver' END AS layer, CAST(k * 7 AS BIGINT) AS source_rows,
  '{"a":1,"k":' || k || '}' AS metrics_json,
  '{' || CASE WHEN k % 3 = 0 THEN '"layer":"silver",' ELSE '' END || '"metrics":{"a":1,"k":' || k || '},'
    || CASE k % 4 WHEN 1 THEN '"size_bytes":null,' WHEN 3 THEN '' ELSE '"size_bytes":' || (k * 1000) || ',' END
    || '"source":{"filename":"' || event_type || '.parquet","service":"s' || run_id || '","size_bytes":' || (k * 5)
    || ',"year":2024},"source_rows":' || (k * 7) || '}' AS details_json
FROM (SELECT *, CAST(json_extract(details, '$.k') AS INTEGER) AS k FROM audit)
""")
_FLAT = (
    "event_id", "event_type", "status", "run_id", "filename", "service", "year",
    "size_bytes", "layer", "source_rows", "metrics_json", "details_json",
)


@query("audit_flat", sql(
    f"SELECT {', '.join(_FLAT)}, CAST(NULL AS INTEGER) AS month, CAST(NULL AS VARCHAR) AS error FROM flat", "flat"))
def audit_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.flatten_events(detailed_events(spark, sf_dir)).select(*_FLAT, "month", "error")


@query("audit_counts", sql("""
SELECT event_type, status, CAST(grouping_id(event_type, status) AS INTEGER) AS set_id, count(*) AS events
FROM audit GROUP BY GROUPING SETS ((event_type), (status), (event_type, status), ())
""", "audit"))
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.event_counts(audit_events(spark, sf_dir))


@query("latest_event", sql(f"""
SELECT event_type, event_id, status, run_id, details, {stamp_sql("timestamp_utc")}
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY timestamp_utc DESC, event_id DESC) AS n FROM audit WHERE status <> 'FAILED')
WHERE n = 1
""", "audit"))
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each type that did not fail."""
    passed = audit_events(spark, sf_dir).where("status <> 'FAILED'")
    return log.latest_by(passed, "event_type").select(
        "event_type", "event_id", "status", "run_id", "details", stamp("timestamp_utc")
    )


@query("file_current_state", sql("""
SELECT run_id, status, details, strftime(created, '%Y-%m-%d %H:%M:%S') AS created_at_utc,
  strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated_at_utc, changes
FROM (
  SELECT run_id, status, details, min(timestamp_utc) OVER w AS created, max(timestamp_utc) OVER w AS updated,
    count(*) OVER w AS changes, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_utc DESC, event_id DESC) AS n
  FROM audit WINDOW w AS (PARTITION BY run_id)
) WHERE n = 1
""", "audit"))
def file_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = audit_events(spark, sf_dir).withColumnRenamed("run_id", "file_id")
    state = log.current_state(events.withColumn("run_id", F.col("file_id")), "file_id")
    return state.select(
        F.col("file_id").alias("run_id"),
        "status",
        "details",
        stamp("created_at_utc"),
        stamp("updated_at_utc"),
        "changes",
    )


@query("file_status_history", sql(f"""
SELECT run_id AS file_id, event_id, status, {stamp_sql("timestamp_utc")} FROM audit
""", "audit"))
def file_status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = audit_events(spark, sf_dir).withColumn("file_id", F.col("run_id"))
    history = log.status_history(events, "file_id")
    return history.select("file_id", "event_id", "status", stamp("timestamp_utc"))


block("audit_contract", "flat", body=contract_sql(
    "flat", date="strftime(timestamp_utc, '%Y-%m-%d')", year="CAST(year(timestamp_utc) AS INTEGER)",
    month="CAST(month(timestamp_utc) AS INTEGER)", service="service", category="event_type", series="status",
    metric_name="'Eventos de auditoría'", metric_value="1.0::DOUBLE", metric_aux="coalesce(size_bytes, source_rows)::DOUBLE",
    status="status", detail="'Trazabilidad de ejecuciones, archivos, calidad y modelos'"))


def audit_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_contract(log.flatten_events(detailed_events(spark, sf_dir)), "D10_Auditoria")


@query("contract_d10", sql("SELECT * FROM audit_contract", "audit_contract"))
def contract_d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_contract(spark, sf_dir)


@query("measures_audit", sql("""
SELECT category, sum(metric_value) AS events, sum(CASE WHEN status IN ('PASSED', 'OK') THEN metric_value END) AS events_ok
FROM audit_contract GROUP BY ALL
""", "audit_contract"))
def measures_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_by(audit_contract(spark, sf_dir), "audit", ("category",))


@query("page_10", sql(page_sql(
    "audit_contract", "sum(metric_value)", "sum(CASE WHEN status IN ('PASSED', 'OK') THEN metric_value END)",
    "audit_contract.category", "audit_contract.date", "audit_contract.series"), "audit_contract"))
def page_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_query(audit_contract(spark, sf_dir), PAGES["page_10"])


@query("page_10_sliced", sql(page_sql(
    "(SELECT * FROM audit_contract WHERE status = 'PASSED' AND service IN ('s3', 's6', 's9', 's12'))", "sum(metric_value)",
    "sum(CASE WHEN status IN ('PASSED', 'OK') THEN metric_value END)", "category", "date", "series"), "audit_contract"))
def page_10_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = {"status": ("PASSED",), "service": ("s3", "s6", "s9", "s12")}
    return page_query(audit_contract(spark, sf_dir), PAGES["page_10"], chosen)


# --- verification ---------------------------------------------------------------------------


@query("metric_bounds")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_bounds(metrics(spark, sf_dir))


@query("verification_report")
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over the workload's own layers; six of twelve months do not exist, so the
    completeness check reports them and the others pass."""
    silver = silver_trips(spark, sf_dir)
    facts = trip_facts(spark, sf_dir).selectExpr(
        "family AS service", "file_year AS year", "file_month AS month"
    )
    grid = catalog.expected_files(spark, SCOPE)
    events = detailed_events(spark, sf_dir)
    renamed = events.withColumn(
        "event_type",
        F.expr("element_at(array('pipeline_run', 'file_status', 'quality_result', 'model_run'), "
               "CAST(CAST(event_id AS bigint) % 4 + 1 AS int))"),
    ).withColumn("status", F.expr("CASE WHEN status = 'OK' THEN 'VALIDATED' ELSE status END"))
    results = ("forecast", "segments", "classification")
    names = ("daily", "hourly", "finance", "routes", "tips", "anomalies")
    gold = {name: fact_rows(spark, sf_dir, name) for name in names}
    sources = {**gold, **{n: result(spark, sf_dir, n) for n in results}}
    flat = log.flatten_events(renamed)
    sources["audit"] = flat
    contracts = {n: build_contract(sources[spec.table], n) for n, spec in CONTRACTS.items()}
    hashed = files.file_integrity(files.list_files(spark, sf_dir, "*.parquet"))
    in_lake = silver.groupBy("source_file").agg(F.count(F.lit(1)).alias("length"))
    paths = in_lake.selectExpr("concat('lake:/trips/', source_file) AS path", "length")
    return verify_lake(
        expected=catalog.expected_files(spark, SCOPE, include_current=False),
        foreign=paths.join(files.trip_files(paths).select("path"), "path", "left_anti"),
        missing=catalog.missing_files(grid, silver, SCOPE.historical_years),
        integrity=hashed.selectExpr("CASE WHEN parquet_magic THEN 'OK' ELSE 'PARQUET_MAGIC' END AS verdict"),
        zones=zone_lookup(spark, sf_dir),
        reconciled=reconcile_counts(facts, silver, invalid_only(silver)),
        marts=gold,
        metrics=metrics(spark, sf_dir),
        events=renamed,
        exported_events=flat,
        contracts=contracts,
    )
