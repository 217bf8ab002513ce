"""The whole path: monthly files -> Silver and quarantine -> marts -> models -> contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from curbflow.operators import marts
from curbflow.operators.diagnostics import daily_anomalies, demand_labels
from curbflow.operators.quality import with_quality
from curbflow.operators import audit
from curbflow.operators.reconcile import reconcile_counts, reconcile_total
from curbflow.plans.contracts import CONTRACTS, build_contract
from curbflow.plans.model_runs import ModelRun, all_metrics, run_models
from curbflow.plans.model_store import publish_model
from curbflow.settings import ANOMALY_THRESHOLD, SERVICES, ModelSettings, QualityLimits
from curbflow.sources.files import TRIP_FILE, file_inventory, list_files
from curbflow.sources.lake import EVENT_SCHEMA, read_bronze, read_silver, read_valid_trips
from curbflow.sources.sinks import (
    append_events,
    delete_path,
    write_csv,
    write_mart,
    write_quarantine,
    write_result,
    write_silver,
)

# Base mart -> how it is summed from the hourly base.
FROM_BASE = {
    "daily": marts.DAILY_DEMAND,
    "hourly": marts.HOURLY_PROFILE,
    "finance": marts.SERVICE_FINANCIALS,
    "tips": marts.TIP_FACTORS,
}


@dataclass(frozen=True)
class LakePaths:
    root: str

    def layer(self, *names: str) -> str:
        return "/".join([self.root.rstrip("/"), *names])

    def mart(self, name: str) -> str:
        return self.layer("gold", name)


def build_silver(
    spark: SparkSession,
    bronze: str,
    lake: LakePaths,
    *,
    services: Sequence[str] = SERVICES,
    limits: QualityLimits = QualityLimits(),
    filenames: Sequence[str] | None = None,
) -> DataFrame:
    """Write Silver and quarantine for every file found, or for those named; returns the per-file
    reconciliation.

    Source rows are counted from the files themselves, Silver and quarantine from what was
    written. A file that does not balance is an error.
    """
    trips, inventory = read_bronze(spark, bronze, services, filenames=filenames)
    observed = write_silver(with_quality(trips, limits), lake.layer("silver"))
    periods = inventory.select("service", "year", "month")
    silver = read_silver(spark, lake.layer("silver")).join(
        periods, ["service", "year", "month"], "left_semi"
    )
    write_quarantine(silver, lake.layer("quarantine"))
    name = f"regexp_extract(source_file, r'{TRIP_FILE}', %d)"
    source = trips.selectExpr(
        f"lower({name % 1}) AS service",
        f"CAST({name % 2} AS int) AS year",
        f"CAST({name % 3} AS int) AS month",
    )
    quarantine = spark.read.schema(silver.schema).parquet(lake.layer("quarantine")).join(
        periods, ["service", "year", "month"], "left_semi"
    )
    counted = reconcile_counts(source, silver, quarantine)
    # Files, Silver and quarantine are read for the counts once; each later look would read them again.
    balance = spark.createDataFrame(counted.collect(), counted.schema)  # one row per file
    off = balance.where("NOT reconciled").first()
    if off:
        raise RuntimeError(f"rows were lost in {off.service} {off.year}-{off.month:02d}")
    total = reconcile_total(balance).first()
    if (observed["rows"], observed["valid_rows"]) != (total["silver_rows"], total["valid_rows"]):
        raise RuntimeError(f"Silver holds other rows than were written: {observed}")
    return balance


def build_base_marts(
    spark: SparkSession,
    lake: LakePaths,
    zones: DataFrame,
    *,
    year: int | None = None,
    month: int | None = None,
    route_sketches: bool = False,
) -> dict[str, int]:
    """Write the marts summed from trips, of all months or of one; a month that has no valid trip
    left loses its rows."""
    scope = {"year": year, "month": month}
    if (year is None) != (month is None):
        raise ValueError("scope a run by year and month together")
    trips = read_valid_trips(spark, lake.layer("silver"), zones, **scope)
    names = ("base", *FROM_BASE, "routes", *(["route_base"] if route_sketches else []))
    if year is not None and trips.isEmpty():
        for name in names:
            delete_path(spark, f"{lake.mart(name)}/pickup_year={year}/pickup_month={month}")
        return dict.fromkeys(names, 0)
    rows = {"base": write_mart(marts.trip_base(trips), lake.mart("base"), **scope)}
    base = spark.read.parquet(lake.mart("base"))
    if year is not None:
        base = base.where(f"pickup_year = {year} AND pickup_month = {month}")
    for name, mart in FROM_BASE.items():
        rows[name] = write_mart(mart.build(base, from_base=True), lake.mart(name), **scope)
    rows["routes"] = write_mart(marts.route_performance(trips), lake.mart("routes"), **scope)
    if route_sketches:
        rows["route_base"] = write_mart(marts.route_base(trips), lake.mart("route_base"), **scope)
    return rows


def build_derived_marts(
    spark: SparkSession,
    lake: LakePaths,
    *,
    anomaly_threshold: float = ANOMALY_THRESHOLD,
    high_demand_quantile: float = 0.75,
) -> dict[str, int]:
    """Write the marts that see the full history of the daily and hourly ones."""
    daily = spark.read.parquet(lake.mart("daily"))
    hourly = spark.read.parquet(lake.mart("hourly"))
    derived = {
        "anomalies": daily_anomalies(daily, anomaly_threshold),
        "timeseries_base": marts.timeseries_base(daily),
        "zone_profile_base": marts.zone_profile(daily),
        "demand_labels_base": demand_labels(hourly, high_demand_quantile),
    }
    return {name: write_mart(frame, lake.mart(name)) for name, frame in derived.items()}


def build_marts(
    spark: SparkSession,
    lake: LakePaths,
    zones: DataFrame,
    *,
    year: int | None = None,
    month: int | None = None,
    anomaly_threshold: float = ANOMALY_THRESHOLD,
    high_demand_quantile: float = 0.75,
    route_sketches: bool = False,
) -> dict[str, int]:
    """Write all nine marts; with a year and month only that month of the base marts is redone.
    ``route_sketches`` adds the routes' components with mergeable medians, for coarser grains.

    Silver is read twice in all: once for the hourly base four marts are summed from, once for
    routes, whose median is not additive. Derived marts always see the full history.
    """
    base = build_base_marts(spark, lake, zones, year=year, month=month, route_sketches=route_sketches)
    return base | build_derived_marts(
        spark, lake, anomaly_threshold=anomaly_threshold, high_demand_quantile=high_demand_quantile
    )


def build_models(
    spark: SparkSession, lake: LakePaths, settings: ModelSettings = ModelSettings()
) -> dict[str, ModelRun]:
    """Fit the three models on the daily mart, save them with their cards and publish their results."""
    runs = run_models(spark.read.parquet(lake.mart("daily")), settings)
    for kind, run in runs.items():
        publish_model(run, lake.layer("models", kind), spark)
        for name, frame in run.frames.items():
            write_result(frame, lake.layer("results", name))
    write_result(all_metrics(runs), lake.layer("results", "model_metrics"))
    for run in runs.values():
        run.release()
    return runs


def contract_sources(
    spark: SparkSession, lake: LakePaths, audit: DataFrame
) -> Mapping[str, DataFrame]:
    """Contract table name -> rows: marts, model results and the flattened audit events."""
    results = ("forecast", "segments", "classification")
    gold = ("daily", "hourly", "finance", "routes", "tips", "anomalies")
    return {
        **{name: spark.read.parquet(lake.mart(name)) for name in gold},
        **{name: spark.read.parquet(lake.layer("results", name, "parquet")) for name in results},
        "audit": audit,
    }


def publish_contracts(
    spark: SparkSession, lake: LakePaths, audit: DataFrame, *, single_file: bool = False
) -> dict[str, str]:
    """Write the ten contracts as CSV datasets; a contract without rows is an error."""
    sources = contract_sources(spark, lake, audit)
    written = {}
    for name, spec in CONTRACTS.items():
        path = lake.layer("contracts", name)
        frame = build_contract(sources[spec.table], name)
        if frame.isEmpty():
            raise ValueError(f"contract without rows: {name}")
        write_csv(frame, path, single_file=single_file)
        written[name] = path
    return written


def run_full(
    spark: SparkSession,
    bronze: str,
    lake: LakePaths,
    zones: DataFrame,
    run_id: str,
    *,
    settings: ModelSettings | None = ModelSettings(),
) -> DataFrame:
    """The whole path under audit; returns the lake's flattened events.

    Start and finish of the run, every file, the balance of every file, every mart and every model
    become events. Each stage's are appended when it ends, the start before anything else, so a run
    whose driver is lost shows how far it came. A failure is recorded with its text and raised again.
    Without ``settings`` the run stops after the marts.
    """
    recorded = 0
    events = [audit.run_started(run_id, "full", {"bronze": bronze, "lake": lake.root})]

    def record() -> None:
        nonlocal recorded
        append_events(audit.events_frame(spark, events), lake.layer("audit"))
        recorded += len(events)
        events.clear()

    record()
    try:
        for file in file_inventory(list_files(spark, bronze, "*.parquet")).collect():
            origin = {"filename": file.filename, "service": file.service, "year": file.year, "month": file.month}
            events.append(
                audit.file_status(run_id, origin, "VALIDATED", path=file.path, size_bytes=file.length)
            )
        record()
        for row in build_silver(spark, bronze, lake).collect():  # one row per file
            events.append(audit.quality_result(run_id, "silver", "PASSED", **row.asDict()))
        record()
        for name, rows in build_marts(spark, lake, zones).items():
            status = "PASSED" if rows else "FAILED"
            events.append(audit.quality_result(run_id, "gold", status, name=name, rows=rows))
        record()
        if settings:
            for run in build_models(spark, lake, settings).values():
                events.append(audit.model_run(run_id, run.name, run.metrics))
    except Exception as error:
        events.append(audit.run_finished(run_id, error=f"{type(error).__name__}: {error}"))
        record()
        raise
    events.append(audit.run_finished(run_id, events=recorded + len(events)))
    record()
    flat = audit.flatten_events(spark.read.schema(EVENT_SCHEMA).parquet(lake.layer("audit")))
    if settings:
        publish_contracts(spark, lake, flat)
    return flat
