"""A run that does only what is not done: the lake's own audit events say what that is.

Work is done in units that are right as a whole or are redone: a file's part of Silver, a month of
the base marts, the derived marts together, the three models together. A unit's event is appended
after its data is written, so a run that dies in between leaves the unit open, and the next run does
it again in place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import audit
from curbflow.operators.audit import latest_by
from curbflow.plans.model_runs import CLASSIFY_MODEL, FORECAST_MODEL, SEGMENT_MODEL
from curbflow.plans.model_store import unusable_models
from curbflow.plans.pipeline import (
    LakePaths,
    build_base_marts,
    build_derived_marts,
    build_models,
    build_silver,
    publish_contracts,
)
from curbflow.settings import ModelSettings
from curbflow.sources.files import file_integrity, file_inventory, list_files, trip_files
from curbflow.sources.lake import EVENT_SCHEMA
from curbflow.sources.sinks import append_events, path_exists

MODEL_FOLDERS = {FORECAST_MODEL: "forecast", SEGMENT_MODEL: "segmentation", CLASSIFY_MODEL: "classification"}
MONTH_LAYER = "gold_month"
PERIOD = ("service", "year", "month")


def lake_events(spark: SparkSession, lake: LakePaths) -> DataFrame:
    """The flattened events of a lake; none where nothing has run yet."""
    path = lake.layer("audit")
    events = spark.read.schema(EVENT_SCHEMA).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], EVENT_SCHEMA)
    return audit.flatten_events(events)


def settled_files(flat: DataFrame) -> DataFrame:
    """Name, size and hash of every file whose last reading ended in a Silver that balances.

    A file read again by a run that did not balance it is not settled by an earlier run's success,
    since its months may be half replaced. Files skipped later stay settled.
    """
    read = flat.where("event_type = 'file_status' AND status <> 'SKIPPED'")
    last = latest_by(read, "filename").where("status = 'VALIDATED' AND sha256 IS NOT NULL")
    balanced = flat.where("layer = 'silver' AND status = 'PASSED'").select("run_id", *PERIOD).distinct()
    return last.join(balanced, ["run_id", *PERIOD], "left_semi").select("filename", "size_bytes", "sha256")


def changed_files(inventory: DataFrame, flat: DataFrame) -> DataFrame:
    """``inventory`` (filename, size, sha256, ...) with ``changed``: not settled with these bytes."""
    known = settled_files(flat).selectExpr("filename", "size_bytes AS size", "sha256", "true AS settled")
    return inventory.join(known, ["filename", "size", "sha256"], "left").withColumn(
        "changed", F.col("settled").isNull()
    ).drop("settled")


def open_months(flat: DataFrame) -> DataFrame:
    """Months whose Silver was written after their base marts, or that have none."""
    silver = flat.where("layer = 'silver' AND status = 'PASSED'").groupBy("year", "month").agg(
        F.max("timestamp_utc").alias("silver_at")
    )
    gold = flat.where(f"layer = '{MONTH_LAYER}' AND status = 'PASSED'").groupBy("year", "month").agg(
        F.max("timestamp_utc").alias("gold_at")
    )
    return silver.join(gold, ["year", "month"], "left").select(
        "year", "month", F.expr("gold_at IS NULL OR gold_at < silver_at").alias("open")
    )


def _stage_times(flat: DataFrame) -> dict:
    """When months, derived marts and models were last done; models by the oldest of the three."""
    name = F.get_json_object("details_json", "$.name")
    row = flat.agg(
        F.max(F.when(F.col("layer") == MONTH_LAYER, F.col("timestamp_utc"))).alias("months"),
        F.max(F.when((F.col("layer") == "gold") & (name == "demand_labels_base"), F.col("timestamp_utc"))).alias("derived"),
        *(
            F.max(F.when((F.col("model_name") == m) & (F.col("status") == "SUCCEEDED"), F.col("timestamp_utc"))).alias(m)
            for m in MODEL_FOLDERS
        ),
    ).first()
    fits = [row[m] for m in MODEL_FOLDERS]
    return {"months": row["months"], "derived": row["derived"], "models": None if None in fits else min(fits)}


def _stale(done, after) -> bool:
    return done is None or (after is not None and done < after)


def hashed_inventory(spark: SparkSession, bronze: str) -> DataFrame:
    """Trip files below a folder with the size and hash of their bytes, read by the executors."""
    listed = list_files(spark, bronze, "*.parquet")
    named = trip_files(listed).select("path", "length")
    bytes_read = file_integrity(named).select("path", "size", "sha256", "parquet_magic")
    return file_inventory(listed).join(bytes_read, "path")


def run_resumable(
    spark: SparkSession,
    bronze: str,
    lake: LakePaths,
    zones: DataFrame,
    run_id: str,
    *,
    settings: ModelSettings | None = ModelSettings(),
) -> DataFrame:
    """Bring a lake up to date with its source files under audit; returns its flattened events.

    Files whose bytes are those of their last balanced reading are ``SKIPPED``; others are read and
    replace their part of Silver. Base marts are redone for the months that Silver changed in,
    derived marts when any month was, models when these were or when one cannot be loaded. Contracts
    are published with models, as the audit they include always grows. What an earlier run left
    unfinished counts as not done. A file that is gone keeps its rows; file proofs report it. A file
    that has lost all its rows does not balance and fails the run. Without ``settings`` the run stops
    after the marts.
    """
    def record(events: Iterable[tuple]) -> DataFrame:
        append_events(audit.events_frame(spark, events), lake.layer("audit"))
        return lake_events(spark, lake)

    flat = record([audit.run_started(run_id, "resumable", {"bronze": bronze, "lake": lake.root})])
    try:
        files = changed_files(hashed_inventory(spark, bronze), flat).orderBy(*PERIOD).collect()  # one row a file
        torn = [f.filename for f in files if not f.parquet_magic]
        if torn:
            raise ValueError(f"files that are no Parquet: {torn}")
        events = []
        for f in files:
            origin = {"filename": f.filename, "service": f.service, "year": f.year, "month": f.month}
            status = "VALIDATED" if f.changed else "SKIPPED"
            events.append(audit.file_status(run_id, origin, status, path=f.path, size_bytes=f.size, sha256=f.sha256))
        if events:
            flat = record(events)
        if names := [f.filename for f in files if f.changed]:
            balance = build_silver(spark, bronze, lake, filenames=names).collect()  # one row a file
            flat = record(audit.quality_result(run_id, "silver", "PASSED", **r.asDict()) for r in balance)

        months = open_months(flat).collect()
        pending = [m for m in months if m.open]
        # All months at once where all are open; otherwise only those, one scan of its month each.
        scopes = [{}] if pending and len(pending) == len(months) else [{"year": m.year, "month": m.month} for m in pending]
        for scope in scopes:
            rows = build_base_marts(spark, lake, zones, **scope)
            done = [audit.quality_result(run_id, "gold", "PASSED" if r or scope else "FAILED", name=n, rows=r, **scope) for n, r in rows.items()]
            of = pending if not scope else [m for m in pending if (m.year, m.month) == (scope["year"], scope["month"])]
            done += [audit.quality_result(run_id, MONTH_LAYER, "PASSED", year=m.year, month=m.month) for m in of]
            flat = record(done)

        at = _stage_times(flat)
        if at["months"] is not None and _stale(at["derived"], at["months"]):
            rows = build_derived_marts(spark, lake)
            flat = record(
                audit.quality_result(run_id, "gold", "PASSED" if r else "FAILED", name=n, rows=r) for n, r in rows.items()
            )
            at = _stage_times(flat)
        if settings:
            paths = {name: lake.layer("models", folder) for name, folder in MODEL_FOLDERS.items()}
            if _stale(at["models"], at["derived"]) or not unusable_models(spark, paths).isEmpty():
                runs = build_models(spark, lake, settings).values()
                record([audit.model_run(run_id, run.name, run.metrics) for run in runs])
            else:
                record([audit.event("model_run", "SKIPPED", run_id=run_id, details={"model_name": n}) for n in paths])
    except Exception as error:
        record([audit.run_finished(run_id, error=f"{type(error).__name__}: {error}")])
        raise
    flat = record([audit.run_finished(run_id)])
    if settings:
        publish_contracts(spark, lake, flat)
    return flat
