"""Audit events: construction, flattening, current state, history and summaries.

The event table is append-only. State is derived from it with mergeable aggregates; the history
of a key stays one row per event, so a key that owns a third of all events is just many rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbflow.sources.lake import EVENT_SCHEMA, PROMOTED

HEAD = ("event_id", "event_type", "status", "timestamp_utc", "run_id")


def event(
    event_type: str,
    status: str,
    *,
    run_id: str | None = None,
    details: Mapping[str, Any] | None = None,
    event_id: str | None = None,
    at: datetime | None = None,
) -> tuple:
    """One event row under the event schema."""
    text = json.dumps(details or {}, ensure_ascii=False, sort_keys=True, default=str)
    moment = at or datetime.now(timezone.utc)
    return event_id or str(uuid.uuid4()), event_type, status, moment, run_id, text


def run_started(run_id: str, pipeline: str, parameters: Mapping[str, Any] | None = None) -> tuple:
    details = {"pipeline_name": pipeline, "parameters": dict(parameters or {})}
    return event(
        "pipeline_run", "STARTED", run_id=run_id, details=details, event_id=f"{run_id}:started"
    )


def run_finished(run_id: str, *, error: str | None = None, **metrics: Any) -> tuple:
    return event(
        "pipeline_run",
        "FAILED" if error else "SUCCEEDED",
        run_id=run_id,
        details={"metrics": metrics, "error": error},
        event_id=f"{run_id}:finished",
    )


def file_status(
    run_id: str,
    file: Mapping[str, Any],
    status: str,
    *,
    path: str | None = None,
    size_bytes: int | None = None,
    sha256: str | None = None,
    error: str | None = None,
) -> tuple:
    """One status of one file; what is known of its origin stays under ``source``."""
    url = str(file.get("url", ""))
    name = str(file.get("filename") or url.rsplit("/", 1)[-1])
    details = {
        "file_id": hashlib.sha256((url or name).encode()).hexdigest(),
        "url": url,
        "filename": name,
        "local_path": path,
        "size_bytes": size_bytes,
        "sha256": sha256,
        "error": error,
        "source": dict(file),
    }
    return event("file_status", status, run_id=run_id, details=details)


def quality_result(run_id: str, layer: str, status: str, **details: Any) -> tuple:
    return event("quality_result", status, run_id=run_id, details={"layer": layer, **details})


def model_run(run_id: str, model_name: str, metrics: Mapping[str, Any]) -> tuple:
    details = {"model_name": model_name, "metrics": dict(metrics)}
    return event("model_run", "SUCCEEDED", run_id=run_id, details=details)


def events_frame(spark: SparkSession, events: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(events), EVENT_SCHEMA)


def flatten_events(events: DataFrame) -> DataFrame:
    """22 columns per event; a promoted field is the detail's own, null or not, and its source's
    only where the detail has no such key. Both JSON columns have their keys sorted.

    Details that are no object count as an empty one.
    """
    parsed = events.select(
        *HEAD,
        F.try_parse_json("details").alias("v"),
        F.from_json("details", "map<string,string>").alias("own"),
    ).withColumn("source", F.from_json(F.try_element_at("own", F.lit("source")), "map<string,string>"))
    own = "map_contains_key(own, '%s')"
    return parsed.selectExpr(
        *HEAD,
        *(
            f"try_cast(CASE WHEN {own % n} THEN try_element_at(own, '{n}') "
            f"ELSE try_element_at(source, '{n}') END AS {t}) AS {n}"
            for n, t in PROMOTED.items()
        ),
        f"CASE WHEN {own % 'metrics'} THEN "
        "coalesce(to_json(variant_get(v, '$.metrics', 'variant')), 'null') ELSE '{}' END AS metrics_json",
        "CASE WHEN own IS NOT NULL THEN to_json(v) ELSE '{}' END AS details_json",
    )


def files_by(events: DataFrame, *keys: str) -> DataFrame:
    """Distinct files per key, for instance per service or per year."""
    return events.groupBy(*keys).agg(F.count_distinct("filename").alias("files"))


def latest_by(events: DataFrame, *keys: str) -> DataFrame:
    """The last event of each key; equal times are settled by event id.

    The rank is limited to one before the shuffle as well, so a key with very many events sends one
    row a task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("timestamp_utc"), F.desc("event_id"))
    rest = [c for c in events.columns if c not in keys]
    return events.withColumn("_place", F.row_number().over(newest)).where("_place = 1").select(*keys, *rest)


def current_state(events: DataFrame, key: str) -> DataFrame:
    """Latest status of each key with its first and last time and how often it was seen."""
    span = events.groupBy(key).agg(
        F.min("timestamp_utc").alias("created_at_utc"),
        F.max("timestamp_utc").alias("updated_at_utc"),
        F.count(F.lit(1)).alias("changes"),
    )
    state = latest_by(events, key).select(key, "status", "run_id", "details")
    return state.join(span, state[key].eqNullSafe(span[key])).drop(span[key])


def status_history(events: DataFrame, key: str) -> DataFrame:
    """Every status change in order of key and time, range-partitioned rather than gathered."""
    return events.select(key, "timestamp_utc", "event_id", "status", "run_id").orderBy(
        key, "timestamp_utc", "event_id"
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Events by type, by status, and in total, in one pass."""
    grouped = events.groupingSets(
        [["event_type"], ["status"], ["event_type", "status"], []], "event_type", "status"
    )
    return grouped.agg(
        F.expr("CAST(grouping_id() AS int)").alias("set_id"), F.count(F.lit(1)).alias("events")
    )
