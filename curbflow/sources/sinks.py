"""Writers of the lake's layers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from curbflow.operators.quality import invalid_only
from curbflow.schema import PARTITION_COLUMNS

MART_PARTITIONS = ("pickup_year", "pickup_month")
OPEN_WRITERS = 4
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def rebalanced(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Gather each partition's rows before writing, so files number partitions and not
    tasks × partitions. Adaptive execution splits a hot partition over several tasks and merges
    small ones, so one month holding a third of all rows is still written in parallel."""
    return df.hint("rebalance", *(F.col(key) for key in keys))


def _overwrite_partitions(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


@contextmanager
def open_writers(spark: SparkSession, months: int = OPEN_WRITERS) -> Iterator[None]:
    """Within it, a task keeps the files of up to ``months`` partitions open instead of sorting its rows
    by partition; beyond that many, Spark sorts the rest. A scan of monthly files, and rows that were
    gathered by month, meet few in a task, so a sort would only take memory and spill."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    known = spark.conf.get(name, None)
    spark.conf.set(name, str(months))
    try:
        yield
    finally:
        spark.conf.unset(name) if known is None else spark.conf.set(name, known)


def write_silver(trips: DataFrame, path: str) -> dict[str, int]:
    """Write months in place and count rows in the same action; a re-run replaces its months."""
    seen = Observation()
    observed = trips.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if("dq_valid").alias("valid_rows"),
        F.count_if(~F.col("dq_valid")).alias("invalid_rows"),
    )
    with open_writers(trips.sparkSession):
        _overwrite_partitions(observed, path, PARTITION_COLUMNS)
    return {name: int(value or 0) for name, value in seen.get.items()}


def _hadoop(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a folder through the Hadoop file system it lives on; false when it was not there."""
    filesystem, target = _hadoop(spark, path)
    return filesystem.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = _hadoop(spark, path)
    return filesystem.exists(target)


def write_quarantine(silver: DataFrame, path: str) -> int:
    """Copy invalid rows; a month of ``silver`` that has none left loses its stale partition.

    Dynamic overwrite leaves a partition that receives no rows as it was, so those are deleted by
    name. The names are one line per month in scope, never rows.
    """
    spark = silver.sparkSession
    months = silver.groupBy(*PARTITION_COLUMNS).agg(F.count_if(~F.col("dq_valid")).alias("bad"))
    with open_writers(spark):
        _overwrite_partitions(invalid_only(silver), path, PARTITION_COLUMNS)
    removed = 0
    for row in months.where("bad = 0").collect():
        folder = f"{path.rstrip('/')}/service={row.service}/year={row.year}/month={row.month}"
        removed += bool(delete_path(spark, folder))
    return removed


def write_mart(mart: DataFrame, path: str, *, year: int | None = None, month: int | None = None) -> int:
    """Write a mart, replacing only the months it holds when it has month columns.

    Returns the rows of the scope, read back from the written table.
    """
    keys = tuple(k for k in MART_PARTITIONS if k in mart.columns)
    if keys:
        _overwrite_partitions(rebalanced(mart, keys), path, keys)
    else:
        mart.write.mode("overwrite").parquet(path)
    back = mart.sparkSession.read.parquet(path)
    if keys == MART_PARTITIONS and year is not None:
        back = back.where((F.col("pickup_year") == year) & (F.col("pickup_month") == month))
    return back.count()


def write_csv(
    df: DataFrame, path: str, *, rows_per_file: int = 5_000_000, single_file: bool = False
) -> None:
    """CSV dataset with a header. One file only on request: it runs through a single task."""
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite")
        .option("header", "true")
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("escape", '"')
        .option("maxRecordsPerFile", 0 if single_file else rows_per_file)
        .csv(path)
    )


def write_result(df: DataFrame, path: str) -> None:
    """Publish a result table twice: Parquet for queries, CSV written from that Parquet."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    write_csv(df.sparkSession.read.parquet(f"{path}/parquet"), f"{path}/csv")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def append_events(events: DataFrame, path: str) -> None:
    """Add audit events to the event table; nothing already there is touched."""
    events.write.mode("append").parquet(path)


def export_events(flat: DataFrame, path: str) -> None:
    """Flattened audit events as CSV and as JSON lines."""
    write_csv(flat, f"{path}/csv")
    flat.write.mode("overwrite").json(f"{path}/json")
