"""Verification as data: every check is rows of one tall report, none stops the others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.operators.audit import latest_by
from curbflow.plans.model_runs import CLASSIFY_MODEL, FORECAST_MODEL, SEGMENT_MODEL
from curbflow.sources.files import GOOD_FILE, TRIP_FILE

# Metrics a model must report, and the closed range each must lie in.
METRIC_BOUNDS = (
    (FORECAST_MODEL, "rmse", 0.0, None),
    (FORECAST_MODEL, "mae", 0.0, None),
    (FORECAST_MODEL, "r2", None, 1.0),
    (FORECAST_MODEL, "train_rows", 1.0, None),
    (FORECAST_MODEL, "test_rows", 1.0, None),
    (SEGMENT_MODEL, "silhouette", -1.0, 1.0),
    (SEGMENT_MODEL, "k", 2.0, None),
    (SEGMENT_MODEL, "zones", 1.0, None),
    (SEGMENT_MODEL, "clusters_produced", None, None),
    (CLASSIFY_MODEL, "auc_roc", 0.0, 1.0),
    (CLASSIFY_MODEL, "accuracy", 0.0, 1.0),
    (CLASSIFY_MODEL, "f1", 0.0, 1.0),
    (CLASSIFY_MODEL, "train_rows", 1.0, None),
    (CLASSIFY_MODEL, "test_rows", 1.0, None),
)
HISTORICAL_FILES = 144  # four services, three years, twelve months
REQUIRED_MARTS = (
    "daily",
    "hourly",
    "finance",
    "routes",
    "tips",
    "anomalies",
    "timeseries_base",
    "zone_profile_base",
    "demand_labels_base",
)
REQUIRED_MODELS = (FORECAST_MODEL, SEGMENT_MODEL, CLASSIFY_MODEL)
ZONE_COLUMNS = ("location_id", "borough", "zone", "service_zone")
REQUIRED_EVENTS = ("pipeline_run", "file_status", "quality_result", "model_run")


def check(name: str, violations: DataFrame, describe: str) -> DataFrame:
    """A check over its violations: it passes when there are none."""
    return violations.agg(F.count(F.lit(1)).alias("violations")).selectExpr(
        f"'{name}' AS check",
        "violations = 0 AS passed",
        f"CASE WHEN violations = 0 THEN 'ok' ELSE '{describe}' END AS message",
        "violations",
    )


def metric_bounds(metrics: DataFrame) -> DataFrame:
    """Every required metric with its value and whether it is present, finite and in range."""
    spark = metrics.sparkSession
    required = spark.createDataFrame(
        list(METRIC_BOUNDS), "model_name string, metric_name string, low double, high double"
    )
    joined = required.join(metrics, ["model_name", "metric_name"], "left")
    value = F.col("metric_value")
    fits = (
        value.isNotNull()
        & ~F.isnan(value)
        & (F.abs(value) < float("inf"))
        & F.coalesce(value >= F.col("low"), F.lit(True))
        & F.coalesce(value <= F.col("high"), F.lit(True))
    )
    return joined.select("model_name", "metric_name", value, fits.alias("in_range"))


def last_status(
    flat: DataFrame, event_type: str, key: str, expected: Sequence[str], good: str
) -> DataFrame:
    """Those of ``expected`` whose last event of this type is not ``good``, or that have none. An
    event of work skipped as done leaves the one before it standing."""
    own = flat.where(f"event_type = '{event_type}' AND status <> 'SKIPPED'").withColumn("name", F.expr(key)).where("name IS NOT NULL")
    last = latest_by(own, "name").select("name", F.col("status").alias("last_status"))
    wanted = flat.sparkSession.createDataFrame([(n,) for n in expected], "name string")
    return wanted.join(last, "name", "left").where(f"coalesce(last_status, 'NONE') <> '{good}'")


def missing_columns(zones: DataFrame) -> DataFrame:
    absent = [(c,) for c in ZONE_COLUMNS if c not in zones.columns]
    return zones.sparkSession.createDataFrame(absent, "name string")


def verify_run(
    flat: DataFrame, exported: DataFrame, zones: DataFrame, reconciled: DataFrame, proof: DataFrame, unusable: DataFrame
) -> DataFrame:
    """What a run must show: by its own audit, types, files, balance, every mart and every model; by
    ``proof`` of its source files (``prove_files``), that each is there, whole and as recorded; and by ``unusable`` (``unusable_models``) that
    every model can be loaded from where it was saved."""
    spark = flat.sparkSession
    wanted = spark.createDataFrame([(t,) for t in REQUIRED_EVENTS], "event_type string")
    seen = flat.select("event_type").distinct()
    files = flat.where("event_type = 'file_status'")
    foreign = files.where(f"NOT coalesce(filename, '') RLIKE r'{TRIP_FILE}' OR size_bytes IS NULL OR size_bytes <= 0")
    lost = flat.join(exported.select("event_id"), "event_id", "left_anti")
    named = "get_json_object(details_json, '$.name')"
    gold = flat.where("layer = 'gold'")
    reports = (
        check("event_types", wanted.join(seen, "event_type", "left_anti"), "types never recorded"),
        check("files", foreign, "files with a foreign name or no size"),
        check("proven_files", proof.where(~F.col("verdict").isin(*GOOD_FILE)), "files missing, foreign or not as recorded"),
        check("zone_columns", missing_columns(zones), "lookup columns are missing"),
        check("reconciliation", reconciled.where("NOT reconciled"), "row counts do not balance"),
        check("marts", last_status(gold, "quality_result", named, REQUIRED_MARTS, "PASSED"), "marts without a passed last event"),
        check("models", last_status(flat, "model_run", "model_name", REQUIRED_MODELS, "SUCCEEDED"), "models without a successful last run"),
        check("stored_models", unusable, "models that cannot be loaded"),
        check("audit_export", lost, "events missing from the export"),
    )
    return reduce(DataFrame.unionByName, reports)


def verify_lake(
    *,
    expected: DataFrame,
    missing: DataFrame,
    foreign: DataFrame,
    integrity: DataFrame,
    zones: DataFrame,
    reconciled: DataFrame,
    marts: Mapping[str, DataFrame],
    metrics: DataFrame,
    events: DataFrame,
    exported_events: DataFrame,
    contracts: Mapping[str, DataFrame],
) -> DataFrame:
    """One report over scope, files, zones, row balance, marts, models, audit and contracts."""
    spark = zones.sparkSession

    def empty(tables: Mapping[str, DataFrame]) -> DataFrame:
        counts = [
            df.agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(name))
            for name, df in tables.items()
        ]
        return reduce(DataFrame.unionByName, counts).where("rows = 0")

    seen = events.select("event_type").distinct()
    wanted = spark.createDataFrame([(t,) for t in REQUIRED_EVENTS], "event_type string")
    validated = events.where(
        "event_type = 'file_status' AND status IN ('VALIDATED', 'SKIPPED')"
    ).agg(F.count(F.lit(1)).alias("n"))
    log_size = events.agg(F.count(F.lit(1))).scalar()
    exports = exported_events.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != log_size)
    placeholders = [df.where("status = 'PLACEHOLDER'").select("status") for df in contracts.values()]
    differing = integrity.where("verdict <> 'OK'")
    placeholder = reduce(DataFrame.unionByName, placeholders)
    grid = expected.agg(F.count(F.lit(1)).alias("n")).where(f"n <> {HISTORICAL_FILES}")
    reports = (
        check("scope", grid, "the scope does not yield the historical files"),
        check("expected_files", missing, "historical files are missing"),
        check("foreign_files", foreign, "files with an unknown name or year"),
        check("file_integrity", differing, "files differ from their records"),
        check("zone_lookup", zones.where("borough IS NULL"), "zones without a borough"),
        check("reconciliation", reconciled.where("NOT reconciled"), "row counts do not balance"),
        check("marts", empty(marts), "marts without rows"),
        check("models", metric_bounds(metrics).where("NOT in_range"), "metrics out of range"),
        check("event_types", wanted.join(seen, "event_type", "left_anti"), "types never recorded"),
        check("validated_files", validated.where("n = 0"), "no validated file recorded"),
        check("audit_export", exports, "export and log differ in length"),
        check("contracts", empty(contracts), "contracts without rows"),
        check("placeholders", placeholder, "placeholder rows"),
    )
    return reduce(DataFrame.unionByName, reports)


def raise_for_failures(report: DataFrame) -> None:
    failed = report.where("NOT passed").collect()  # one row per check
    if failed:
        listed = "; ".join(f"{r['check']}: {r['message']} ({r['violations']})" for r in failed)
        raise RuntimeError(f"{len(failed)} checks failed: {listed}")
