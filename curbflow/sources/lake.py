"""Readers of the lake's layers: Bronze files, Silver, the zone lookup, audit logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators.canonical import canonical_trips
from curbflow.operators.quality import silver_contract, valid_only
from curbflow.operators.zones import canonical_zones, enrich_trips
from curbflow.settings import SERVICES
from curbflow.sources.files import (
    TRIP_FILE,
    file_inventory,
    list_files,
    open_filesystem,
    trip_files,
)

EVENT_SCHEMA = (
    "event_id string, event_type string, status string, timestamp_utc timestamp, "
    "run_id string, details string"
)


# Fields promoted out of an event's details, with their types.
PROMOTED = {
    "filename": "string",
    "service": "string",
    "year": "int",
    "month": "int",
    "local_path": "string",
    "size_bytes": "bigint",
    "sha256": "string",
    "error": "string",
    "layer": "string",
    "source_rows": "bigint",
    "silver_rows": "bigint",
    "valid_rows": "bigint",
    "quarantine_rows": "bigint",
    "reconciled": "boolean",
    "model_name": "string",
}
FLAT_EVENT_SCHEMA = ", ".join(
    [
        "event_id string, event_type string, status string, timestamp_utc timestamp, run_id string",
        *(f"{name} {dtype}" for name, dtype in PROMOTED.items()),
        "metrics_json string, details_json string",
    ]
)


def _schema_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for uri in batch["path"]:
            filesystem, path = open_filesystem(uri)
            with filesystem.open_input_file(path) as source:
                fields = pq.read_schema(source)
            texts.append("|".join(f"{f.name}:{f.type}" for f in fields))
        yield pd.DataFrame({"path": batch["path"], "service": batch["service"], "schema": texts})


def read_bronze(
    spark: SparkSession,
    root: str,
    services: Sequence[str] = SERVICES,
    *,
    filenames: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Canonical trips of every monthly file below ``root``, or of those named, and their inventory.

    Published schemas drift in names and types, so files are grouped by the schema in their
    footers (read on the executors, files spread over the tasks) and each group is one scan: a
    handful of scans for any number of months. The period of a row comes from its own file's name.
    One row per schema reaches the driver, with the paths it needs to plan the scan.
    """
    listing = list_files(spark, root, "*.parquet")
    if filenames is not None:
        listing = listing.where(F.regexp_extract("path", "[^/]+$", 0).isin(list(filenames)))
    inventory = file_inventory(listing, services)
    spread = trip_files(listing, services).select("path", "service").repartition(
        spark.sparkContext.defaultParallelism, "path"
    )
    by_schema = (
        spread.mapInPandas(_schema_texts, "path string, service string, schema string")
        .groupBy("service", "schema")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
    )
    groups = {(row.service, row.schema): row.paths for row in by_schema.collect()}
    if not groups:
        raise FileNotFoundError(f"no monthly trip files below {root}")
    name = "_metadata.file_name"
    parts = [
        canonical_trips(
            spark.read.parquet(*paths),
            service=service,
            year=f"regexp_extract({name}, r'{TRIP_FILE}', 2)",
            month=f"regexp_extract({name}, r'{TRIP_FILE}', 3)",
            source_file=name,
            source_path="_metadata.file_path",
        )
        for (service, _), paths in sorted(groups.items())
    ]
    return reduce(DataFrame.unionByName, parts), inventory


def read_silver(
    spark: SparkSession, root: str, *, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Silver, whole or one month of it; the filter prunes partitions before any file is opened."""
    silver = spark.read.parquet(root)
    if year is not None:
        silver = silver.where(F.col("year") == year)
    if month is not None:
        silver = silver.where(F.col("month") == month)
    return silver_contract(silver)


def read_valid_trips(
    spark: SparkSession,
    root: str,
    zones: DataFrame,
    *,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    return enrich_trips(valid_only(read_silver(spark, root, year=year, month=month)), zones)


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Zone CSV with a header; every column is read as text and cast, a bad line is an error."""
    reader = spark.read.option("header", "true").option("mode", "FAILFAST")
    return canonical_zones(reader.option("inferSchema", "false").csv(path))


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines audit log: blank lines are skipped, a line that is no object is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    if lines.isEmpty():
        raise ValueError(f"the audit log is empty: {path}")
    whole = F.when(F.col("line").startswith("{"), F.col("line")).otherwise(
        F.raise_error(F.concat(F.lit("malformed audit event, not an object: "), F.col("line")))
    )
    return lines.select(F.from_json(whole, EVENT_SCHEMA, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """The flattened audit export, under its own schema rather than an inferred one."""
    return spark.read.schema(FLAT_EVENT_SCHEMA).option("header", "true").option(
        "escape", '"'
    ).csv(path)
