"""From monthly files to Silver, quarantine and audit, over files written in two spellings each."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import audit
from curbflow.operators.quality import with_quality
from curbflow.operators.reconcile import reconcile_counts
from curbflow.plans.model_runs import CLASSIFY_MODEL, FORECAST_MODEL, SEGMENT_MODEL
from curbflow.plans.model_store import unusable_models
from curbflow.plans.pipeline import LakePaths, build_silver, run_full
from curbflow.plans.verification import verify_run
from curbflow.session import scratch_path
from curbflow.settings import SourceScope
from curbflow.sources import files, sinks
from curbflow.sources.catalog import expected_files
from curbflow.sources.files import file_integrity, file_inventory, list_files
from curbflow.sources.lake import EVENT_SCHEMA, FLAT_EVENT_SCHEMA, read_bronze, read_silver
from curbflow.sources.links import page_links, published_only, trip_links
from curbflow.workload.oracle_base import sql
from curbflow.workload.registry import query
from curbflow.workload.trips import family_files, family_frame, zone_lookup

_BRONZE: dict[tuple[str, str], str] = {}
WRITERS = 48  # files written at once, as far as there are cores; each is a job of one task


def _rename(spark: SparkSession, folder: str, target: str) -> None:
    """Give the one part file of ``folder`` the name a publisher would give it."""
    filesystem, source = sinks._hadoop(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    part = next(f.getPath() for f in filesystem.listStatus(source) if f.getPath().getName().startswith("part-"))
    filesystem.rename(part, path(target))
    filesystem.delete(source, True)


def bronze_files(spark: SparkSession, sf_dir: str) -> str:
    """One file a family and month, as published: even months name their columns in capitals and
    hold location ids as doubles, and a file that is no trip file lies beside them.

    A file is written by one task, that reads the folder of its family and month only; files are
    written side by side."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _BRONZE or not sinks.path_exists(spark, _BRONZE[slot]):
        root = scratch_path(spark, "bronze")
        facts = family_files(spark, sf_dir)

        def publish(period: tuple[str, int]) -> None:
            family, month = period
            rows = family_frame(facts, family).where(f"file_month = {month}").drop("family", "file_year", "file_month")
            if month % 2 == 0:
                types = dict(rows.dtypes)
                rows = rows.select(
                    *(F.col(c).cast("double" if c.lower().endswith("locationid") else types[c]).alias(c.upper()) for c in rows.columns)
                )
            rows.coalesce(1).write.parquet(f"{root}/{family}-{month}")
            _rename(spark, f"{root}/{family}-{month}", f"{root}/{family}_tripdata_2023-{month:02d}.parquet")

        periods = [tuple(r) for r in facts.select("family", "file_month").distinct().collect()]  # at most 48
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(inheritable_thread_target(spark)(publish), sorted(periods)))
        spark.range(3).coalesce(1).write.parquet(f"{root}/foreign")
        _rename(spark, f"{root}/foreign", f"{root}/README.parquet")
        _BRONZE[slot] = root
    return _BRONZE[slot]


@query("bronze_inventory", sql("""
SELECT DISTINCT service, year, month, service || '_tripdata_2023-' || lpad(CAST(month AS VARCHAR), 2, '0') || '.parquet' AS filename
FROM canonical
""", "canonical"))
def bronze_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed trip files; the foreign one is left out."""
    listed = file_inventory(list_files(spark, bronze_files(spark, sf_dir), "*.parquet"))
    return listed.select("service", "year", "month", "filename")


def _copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copy files, up to a given number of bytes each."""
    for batch in batches:
        for row in batch.itertuples():
            store, path = files.open_filesystem(row.path)
            left = row.keep
            with store.open_input_stream(path) as source, store.open_output_stream(files.open_filesystem(row.target)[1]) as out:
                while left and (chunk := source.read(min(left, files.CHUNK_BYTES))):
                    out.write(chunk)
                    left -= len(chunk)
        yield batch[["target"]]


PROOF_YEARS = (2023,)
_PROVEN: dict[tuple[str, str], tuple[str, str]] = {}


def faulty_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A copy of the files with faults, and what was recorded of them while they were right.

    A green file is gone, a yellow one of a year outside the scope is there, a fhv one has lost its
    last bytes, and the record of a fhvhv one has another hash."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _PROVEN or not sinks.path_exists(spark, _PROVEN[slot][1]):
        folder, records = scratch_path(spark, "faulty"), scratch_path(spark, "records")
        listed = list_files(spark, bronze_files(spark, sf_dir), "*.parquet")
        named = F.regexp_extract("path", "[^/]+$", 0)
        spark.range(1).write.parquet(f"{folder}/made")  # the folder exists before tasks write into it
        plan = listed.withColumn("filename", named).where("filename <> 'green_tripdata_2023-02.parquet'").selectExpr(
            "path", "filename", "CASE WHEN filename = 'fhv_tripdata_2023-03.parquet' THEN length - 9 ELSE length END AS keep"
        )
        extra = plan.where("filename = 'yellow_tripdata_2023-01.parquet'").withColumn("filename", F.lit("yellow_tripdata_2031-01.parquet"))
        wanted = plan.unionByName(extra).withColumn("target", F.concat(F.lit(f"{folder}/"), "filename"))
        wanted.select("path", "target", "keep").mapInPandas(_copied, "target string").agg(F.count("target")).collect()
        sinks.delete_path(spark, f"{folder}/made")
        known = file_integrity(listed.where(named.rlike(files.TRIP_FILE))).withColumn("url", F.concat(F.lit("https://data.example.org/"), named))
        known.select("url", "size", "sha256").write.parquet(records)
        _PROVEN[slot] = folder, records
    return _PROVEN[slot]


def proof_of_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, records = faulty_files(spark, sf_dir)
    listed = list_files(spark, folder, "*.parquet")
    known = spark.read.parquet(records)
    sidecars = known.selectExpr(
        "url", "size AS size_bytes", "size AS content_length", "cast(null as string) AS etag",
        "CASE WHEN url LIKE '%/fhvhv_tripdata_2023-04.parquet' THEN sha2(sha256, 256) ELSE upper(sha256) END AS sha256",
    )
    manifest = known.selectExpr("url", "size AS size_bytes", "sha256", "'VALIDATED' AS status", "'v1' AS etag")
    grid = expected_files(spark, SourceScope(historical_years=PROOF_YEARS), include_current=False)
    return files.prove_files(grid, listed, file_integrity(listed), sidecars, manifest, historical_years=PROOF_YEARS)


_PROOF = """
SELECT s || '_tripdata_2023-' || lpad(CAST(m AS VARCHAR), 2, '0') || '.parquet' AS filename,
  CASE WHEN n IS NULL THEN 1 WHEN s = 'green' AND m = 2 THEN 25 ELSE 31 END AS seen_in,
  CASE WHEN n IS NULL OR (s = 'green' AND m = 2) THEN 'FILE_ABSENT' WHEN s = 'fhv' AND m = 3 THEN 'PARQUET_MAGIC'
    WHEN s = 'fhvhv' AND m = 4 THEN 'CHECKSUM' ELSE 'OK' END AS verdict
FROM (SELECT unnest(['yellow', 'green', 'fhv', 'fhvhv']) AS s), (SELECT unnest(range(1, 13)) AS m)
LEFT JOIN (SELECT service, month, count(*) AS n FROM canonical GROUP BY ALL) ON service = s AND month = m
UNION ALL SELECT 'yellow_tripdata_2031-01.parquet', 6, 'OUT_OF_SCOPE'
UNION ALL SELECT 'README.parquet', 6, 'UNKNOWN_NAME'
"""


@query("proven_files", sql(_PROOF, "canonical"))
def proven_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid, listing, bytes, sidecars and manifest of real files with four planted faults."""
    return proof_of_faulty(spark, sf_dir)


@query("file_hashes", sql("""
SELECT DISTINCT service || '_tripdata_2023-' || lpad(CAST(month AS VARCHAR), 2, '0') || '.parquet' AS filename,
  NOT (service = 'fhv' AND month = 3) AS parquet_magic, true AS as_listed, true AS hash_found
FROM canonical WHERE NOT (service = 'green' AND month = 2)
""", "canonical"))
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, magic and hash read in chunks agree with the listing and with Spark's own hash of the
    whole content; a cut file lacks its last magic bytes."""
    folder, _ = faulty_files(spark, sf_dir)
    listed = list_files(spark, folder, "*_tripdata_2023-*.parquet")
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*_tripdata_2023-*.parquet").load(folder)
    own = whole.select("path", F.sha2("content", 256).alias("own_hash"))
    return file_integrity(listed).join(listed, "path").join(own, "path").select(
        F.regexp_extract("path", "[^/]+$", 0).alias("filename"), "parquet_magic",
        (F.col("size") == F.col("length")).alias("as_listed"), (F.col("sha256") == F.col("own_hash")).alias("hash_found"),
    )


@query("published_files", """
SELECT s AS service, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month
FROM (SELECT unnest(['yellow', 'green', 'fhv', 'fhvhv']) AS s), (SELECT unnest([2025, 2026]) AS y), (SELECT unnest(range(1, 13)) AS m)
WHERE y = 2025 OR EXISTS (SELECT 1 FROM pages WHERE page_id % 13 <> 0 AND page_id % 9 + 1 = m AND page_id % 2 = 0 AND s IN ('yellow', 'fhvhv'))
""")
def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that count: all of the past years, and those of the current year that a page links to.
    Each page gets a link to one file of this year, some inside a comment."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    named = F.format_string(
        "<a class=x href='/trip-data/%s_tripdata_2026-%02d.parquet'>file</a>",
        F.when(F.col("page_id") % 4 == 0, "yellow").otherwise("fhvhv"), F.col("page_id") % 9 + 1,
    )
    both = F.concat(named, F.replace(named, F.lit("yellow"), F.lit("fhvhv")), F.replace(named, F.lit("fhvhv"), F.lit("yellow")))
    hidden = F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("<!-- "), both, F.lit(" -->"))).when(F.col("page_id") % 2 == 0, both)
    linked = trip_links(page_links(pages.withColumn("html", F.concat_ws(" ", hidden, "html"))))
    scope = SourceScope(historical_years=(2025,), current_year=2026)
    return published_only(expected_files(spark, scope), linked, [2025]).select("service", "year", "month")


@query("bronze_scan", sql("""
SELECT service, month, source_file, count(*) AS trips, count(pickup_location_id) AS with_origin, count(trip_distance) AS measured,
  sum(coalesce(total_amount, 0)) AS amount, count(vendor_id) AS with_vendor, count(request_datetime) AS requested
FROM canonical GROUP BY ALL
""", "canonical"))
def bronze_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both spellings of every family read as one canonical table."""
    trips, _ = read_bronze(spark, bronze_files(spark, sf_dir))
    return trips.groupBy("service", F.col("month").cast("int").alias("month"), "source_file").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count("pickup_location_id").alias("with_origin"),
        F.count("trip_distance").alias("measured"),
        F.sum(F.coalesce("total_amount", F.lit(0.0))).alias("amount"),
        F.count("vendor_id").alias("with_vendor"),
        F.count("request_datetime").alias("requested"),
    )


_BALANCE = """
SELECT service, year, month, count(*) AS source_rows, count(*) AS silver_rows,
  CAST(count(*) FILTER (WHERE dq_valid) AS BIGINT) AS valid_rows,
  CAST(count(*) FILTER (WHERE NOT dq_valid AND {kept}) AS BIGINT) AS quarantine_rows,
  count(*) = count(*) FILTER (WHERE dq_valid) + count(*) FILTER (WHERE NOT dq_valid AND {kept}) AS reconciled
FROM silver GROUP BY ALL
"""


@query("bronze_reconciliation", sql(_BALANCE.format(kept="true"), "silver"))
def bronze_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, Silver and quarantine written by the pipeline, each counted from what was written."""
    return build_silver(spark, bronze_files(spark, sf_dir), LakePaths(scratch_path(spark, "lake")))


@query("bronze_lost_rows", sql(_BALANCE.format(kept="(month <> 3 OR service <> 'green')"), "silver"))
def bronze_lost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarantine that has lost one file's rows does not balance, for that file alone."""
    lake = LakePaths(scratch_path(spark, "lake"))
    bronze = bronze_files(spark, sf_dir)
    build_silver(spark, bronze, lake)
    silver = read_silver(spark, lake.layer("silver"))
    lost = spark.read.schema(silver.schema).parquet(lake.layer("quarantine")).where("month <> 3 OR service <> 'green'")
    trips, _ = read_bronze(spark, bronze)
    return reconcile_counts(trips.select("service", "year", "month"), silver, lost)


@query("write_counts", sql("""
SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE dq_valid) AS BIGINT) AS valid_rows,
  CAST(count(*) FILTER (WHERE NOT dq_valid) AS BIGINT) AS invalid_rows
FROM silver
""", "silver"))
def write_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that writing Silver observed on its way."""
    trips, _ = read_bronze(spark, bronze_files(spark, sf_dir))
    seen = sinks.write_silver(with_quality(trips), scratch_path(spark, "observed"))
    names = ("rows", "valid_rows", "invalid_rows")
    return spark.range(1).select(*(F.lit(seen[n]).cast("bigint").alias(n) for n in names))


@query("run_events", sql("""
SELECT event_type, status, layer, count(*) AS events, CAST(sum(source_rows) AS BIGINT) AS source_rows FROM (
  SELECT 'pipeline_run' AS event_type, unnest(['STARTED', 'SUCCEEDED']) AS status, NULL AS layer, NULL::BIGINT AS source_rows
  UNION ALL SELECT DISTINCT ON (service, month) 'file_status', 'VALIDATED', NULL, NULL FROM canonical
  UNION ALL SELECT 'quality_result', 'PASSED', 'silver', count(*) FROM canonical GROUP BY service, month
  UNION ALL SELECT 'quality_result', 'PASSED', 'gold', NULL FROM (SELECT unnest(range(10)))
) GROUP BY ALL
""", "canonical"))
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run over the files, up to the marts, read back from the audit table."""
    lake = LakePaths(scratch_path(spark, "lake"))
    flat = run_full(spark, bronze_files(spark, sf_dir), lake, zone_lookup(spark, sf_dir), "r1", settings=None)
    return flat.groupBy("event_type", "status", "layer").agg(
        F.count(F.lit(1)).alias("events"), F.sum("source_rows").alias("source_rows")
    )


@query("verification_run", sql("""
SELECT * FROM (VALUES ('event_types', false, 1::BIGINT), ('files', true, 0), ('zone_columns', true, 0),
  ('proven_files', false, (SELECT 48 - count(DISTINCT (service, month)) FROM silver) + 5), ('reconciliation', false,
    (SELECT count(DISTINCT (service, month)) FROM silver WHERE NOT dq_valid AND month = 3 AND service = 'green')),
  ('marts', false, 1), ('models', false, 3), ('stored_models', false, 3), ('audit_export', true, 0)) t("check", passed, violations)
""", "silver"))
def verification_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without models, with one file's quarantine lost and one mart failing later: the report
    names exactly these faults. Events come back from the exported file."""
    lake = LakePaths(scratch_path(spark, "lake"))
    zones = zone_lookup(spark, sf_dir)
    bronze = bronze_files(spark, sf_dir)
    flat = run_full(spark, bronze, lake, zones, "r1", settings=None)
    later = audit.quality_result("r2", "gold", "FAILED", name="routes", rows=0)
    sinks.append_events(audit.events_frame(spark, [later]), lake.layer("audit"))
    flat = audit.flatten_events(spark.read.schema(EVENT_SCHEMA).parquet(lake.layer("audit")))
    sinks.export_events(flat, lake.layer("export"))
    exported = spark.read.schema(FLAT_EVENT_SCHEMA).json(lake.layer("export", "json"))
    silver = read_silver(spark, lake.layer("silver"))
    lost = spark.read.schema(silver.schema).parquet(lake.layer("quarantine")).where("month <> 3 OR service <> 'green'")
    trips, _ = read_bronze(spark, bronze)
    balance = reconcile_counts(trips.select("service", "year", "month"), silver, lost)
    proof = proof_of_faulty(spark, sf_dir)
    kinds = {FORECAST_MODEL: "forecast", SEGMENT_MODEL: "segmentation", CLASSIFY_MODEL: "classification"}
    unusable = unusable_models(spark, {name: lake.layer("models", kind) for name, kind in kinds.items()})
    return verify_run(flat, exported, zones, balance, proof, unusable).select("check", "passed", "violations")
