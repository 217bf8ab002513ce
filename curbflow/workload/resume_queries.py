"""Three resumable runs with models over one lake: all files, one file changed, nothing changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators.reconcile import reconcile_counts
from curbflow.plans.contracts import CONTRACTS
from curbflow.plans.model_store import unusable_models
from curbflow.plans.pipeline import LakePaths
from curbflow.plans.resume import MODEL_FOLDERS, lake_events, run_resumable, settled_files
from curbflow.plans.verification import verify_run
from curbflow.session import scratch_path
from curbflow.settings import ModelSettings, SourceScope
from curbflow.sources import files, sinks
from curbflow.sources.catalog import expected_files
from curbflow.sources.files import file_integrity, list_files
from curbflow.sources.lake import FLAT_EVENT_SCHEMA, read_bronze, read_silver
from curbflow.workload.bronze_queries import PROOF_YEARS, _copied, _rename, bronze_files
from curbflow.workload.oracle_base import sql
from curbflow.workload.registry import query, tidied, tidy_sql
from curbflow.workload.trips import zone_lookup

# These queries prove the run: what is redone, recorded, published and verified. The models' figures
# are proven by the queries over models at their published settings; here they are small.
SMALL_MODELS = ModelSettings(forecast_trees=4, forecast_depth=3, classify_trees=6, classify_depth=4)
CHANGED = "green_tripdata_2023-03.parquet"
_LAKES: dict[tuple[str, str], tuple[str, LakePaths]] = {}


def changed_sql(body: str, *needs: str) -> str:
    """SQL over the files as they are after the change: the changed one has lost its mornings."""
    gone = "service = 'green' AND month = 3 AND hour(pickup_datetime) < 12"
    return sql(body, *needs).replace("FROM canonical\n", f"FROM (SELECT * FROM canonical WHERE NOT ({gone}))\n")


def resumed_lake(spark: SparkSession, sf_dir: str) -> tuple[str, LakePaths]:
    """Source folder and lake after the three runs, made once a session."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _LAKES or not sinks.path_exists(spark, _LAKES[slot][1].layer("audit")):
        folder, lake = scratch_path(spark, "sources"), LakePaths(scratch_path(spark, "resumed"))
        zones = zone_lookup(spark, sf_dir)
        listed = list_files(spark, bronze_files(spark, sf_dir), "*_tripdata_*.parquet")
        spark.range(1).write.parquet(f"{folder}/made")  # the folder exists before tasks write into it
        target = F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", "[^/]+$", 0))
        plan = listed.select("path", target.alias("target"), F.col("length").alias("keep"))
        plan.mapInPandas(_copied, "target string").agg(F.count("target")).collect()
        sinks.delete_path(spark, f"{folder}/made")
        run_resumable(spark, folder, lake, zones, "r1", settings=SMALL_MODELS)
        old = spark.read.parquet(f"{folder}/{CHANGED}")
        began = next(c for c in old.columns if c.lower().endswith("pickup_datetime"))
        part = scratch_path(spark, "afternoons")
        old.where(F.hour(began) >= 12).coalesce(1).write.parquet(part)  # a published file is one file
        sinks.delete_path(spark, f"{folder}/{CHANGED}")
        _rename(spark, part, f"{folder}/{CHANGED}")
        spark.catalog.refreshByPath(f"{folder}/{CHANGED}")
        for run_id in ("r2", "r3"):
            run_resumable(spark, folder, lake, zones, run_id, settings=SMALL_MODELS)
        _LAKES[slot] = folder, lake
    return _LAKES[slot]


_FILES = "(SELECT count(DISTINCT (service, month)) FROM canonical)"
_MONTHS = "(SELECT count(DISTINCT month) FROM canonical)"
_LEFT = "(SELECT count(*) FROM canonical WHERE service = 'green' AND month = 3 AND hour(pickup_datetime) >= 12)"


@query("full_run_events", sql(f"""
SELECT run_id, event_type, status, layer, CAST(events AS BIGINT) AS events, CAST(source_rows AS BIGINT) AS source_rows FROM (
  SELECT unnest(['r1', 'r2', 'r3']) AS run_id, 'pipeline_run' AS event_type, 'STARTED' AS status, NULL AS layer, 1 AS events, NULL AS source_rows
  UNION ALL SELECT unnest(['r1', 'r2', 'r3']), 'pipeline_run', 'SUCCEEDED', NULL, 1, NULL
  UNION ALL SELECT 'r1', 'file_status', 'VALIDATED', NULL, {_FILES}, NULL
  UNION ALL SELECT 'r2', 'file_status', 'VALIDATED', NULL, 1, NULL
  UNION ALL SELECT 'r2', 'file_status', 'SKIPPED', NULL, {_FILES} - 1, NULL
  UNION ALL SELECT 'r3', 'file_status', 'SKIPPED', NULL, {_FILES}, NULL
  UNION ALL SELECT 'r1', 'quality_result', 'PASSED', 'silver', {_FILES}, (SELECT count(*) FROM canonical)
  UNION ALL SELECT 'r2', 'quality_result', 'PASSED', 'silver', 1, {_LEFT}
  UNION ALL SELECT unnest(['r1', 'r2']), 'quality_result', 'PASSED', 'gold', 10, NULL
  UNION ALL SELECT 'r1', 'quality_result', 'PASSED', 'gold_month', {_MONTHS}, NULL
  UNION ALL SELECT 'r2', 'quality_result', 'PASSED', 'gold_month', 1, NULL
  UNION ALL SELECT unnest(['r1', 'r2']), 'model_run', 'SUCCEEDED', NULL, 3, NULL
  UNION ALL SELECT 'r3', 'model_run', 'SKIPPED', NULL, 3, NULL
)
""", "canonical"))
def full_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three runs did: everything; one file, its month and what follows from it; nothing."""
    _, lake = resumed_lake(spark, sf_dir)
    return lake_events(spark, lake).groupBy("run_id", "event_type", "status", "layer").agg(
        F.count(F.lit(1)).alias("events"), F.sum("source_rows").alias("source_rows")
    )


_MEANS = ("avg_total_amount", "avg_tip_amount")


@query("full_run_finance", changed_sql(f"SELECT * REPLACE ({tidy_sql(*_MEANS)}) FROM finance", "finance"))
def full_run_finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart of the resumed lake is the mart of the changed files, changed month and others alike."""
    _, lake = resumed_lake(spark, sf_dir)
    return tidied(spark.read.parquet(lake.mart("finance")), *_MEANS)


@query("full_run_contracts", changed_sql(f"""
SELECT contract, CAST(n AS BIGINT) AS rows, CAST(11 AS INTEGER) AS columns, CAST(0 AS BIGINT) AS placeholders FROM (
  SELECT 'D01_Resumen' AS contract, (SELECT count(*) FROM daily) AS n
  UNION ALL SELECT 'D02_Demanda', (SELECT count(*) FROM hourly)
  UNION ALL SELECT 'D03_Ingresos', (SELECT count(*) FROM finance)
  UNION ALL SELECT 'D04_Causas', (SELECT count(*) FROM daily)
  UNION ALL SELECT 'D05_Rutas', (SELECT count(*) FROM routes)
  UNION ALL SELECT 'D06_Anomalias', (SELECT count(*) FROM tips)
  UNION ALL SELECT 'D07_Pronostico', (SELECT 30 * count(DISTINCT service_type) FROM panel)
  UNION ALL SELECT 'D08_Segmentacion', (SELECT count(*) FROM zone_vectors)
  UNION ALL SELECT 'D09_Clasificacion', (SELECT count(*) FROM model_split WHERE split = 'test')
  UNION ALL SELECT 'D10_Auditoria', 3 * {_FILES} + {_FILES} + 1 + {_MONTHS} + 1 + 20 + 9 + 6
)
""", "daily", "hourly", "finance", "routes", "tips", "panel", "zone_vectors", "model_split"))
def full_run_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as a consumer reads them: from the CSV that the last run wrote."""
    _, lake = resumed_lake(spark, sf_dir)
    parts = []
    for name in CONTRACTS:
        read = spark.read.option("header", "true").option("escape", '"').csv(lake.layer("contracts", name))
        parts.append(read.agg(
            F.lit(name).alias("contract"), F.count(F.lit(1)).alias("rows"), F.lit(len(read.columns)).alias("columns"),
            F.count_if(F.col("status") == "PLACEHOLDER").alias("placeholders"),
        ))
    return reduce(DataFrame.unionByName, parts)


@query("full_run_verification", sql(f"""
SELECT * FROM (VALUES ('event_types', true, 0::BIGINT), ('files', true, 0), ('zone_columns', true, 0),
  ('proven_files', {_FILES} = 48, 48 - {_FILES}), ('reconciliation', true, 0), ('marts', true, 0), ('models', true, 0),
  ('stored_models', true, 0), ('audit_export', true, 0)) t("check", passed, violations)
""", "canonical"))
def full_run_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resumed lake under verification, its ledger standing as sidecars and manifest. Files of
    months that were never published are missing; models skipped by the last run count by the one that
    fitted them."""
    folder, lake = resumed_lake(spark, sf_dir)
    flat = lake_events(spark, lake)
    sinks.export_events(flat, lake.layer("export"))
    exported = spark.read.schema(FLAT_EVENT_SCHEMA).json(lake.layer("export", "json"))
    silver = read_silver(spark, lake.layer("silver"))
    quarantine = spark.read.schema(silver.schema).parquet(lake.layer("quarantine"))
    trips, _ = read_bronze(spark, folder)
    balance = reconcile_counts(trips.select("service", "year", "month"), silver, quarantine)
    listed = list_files(spark, folder, "*.parquet")
    known = settled_files(flat).withColumn("url", F.concat(F.lit("https://data.example.org/"), "filename"))
    sidecars = known.selectExpr("url", "size_bytes", "size_bytes AS content_length", "cast(null AS string) AS etag", "sha256")
    manifest = known.selectExpr("url", "size_bytes", "sha256", "'VALIDATED' AS status", "cast(null AS string) AS etag")
    grid = expected_files(spark, SourceScope(historical_years=PROOF_YEARS), include_current=False)
    proof = files.prove_files(grid, listed, file_integrity(listed), sidecars, manifest, historical_years=PROOF_YEARS)
    unusable = unusable_models(spark, {name: lake.layer("models", kind) for name, kind in MODEL_FOLDERS.items()})
    return verify_run(flat, exported, zone_lookup(spark, sf_dir), balance, proof, unusable).select("check", "passed", "violations")
