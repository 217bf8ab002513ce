"""The grid of monthly files a complete lake must hold, and what is missing from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.text import trip_filename
from curbflow.schema import PARTITION_COLUMNS
from curbflow.settings import SourceScope


def expected_files(
    spark: SparkSession, scope: SourceScope = SourceScope(), *, include_current: bool = True
) -> DataFrame:
    """Services × years × twelve months, with published name and URL."""
    years = [*scope.historical_years, *([scope.current_year] if include_current else [])]
    services = ", ".join(f"'{s}'" for s in scope.services)
    return (
        spark.range(1)
        .selectExpr(f"posexplode(array({services})) AS (service_rank, service)")
        .selectExpr("*", f"explode(array({', '.join(map(str, years))})) AS year")
        .selectExpr("*", "explode(sequence(1, 12)) AS month")
        .selectExpr("*", f"{trip_filename('service', 'year', 'month')} AS filename")
        .selectExpr("*", f"concat('{scope.base_url.rstrip('/')}/', filename) AS url")
    )


def missing_files(
    expected: DataFrame, observed: DataFrame, historical_years: tuple[int, ...]
) -> DataFrame:
    """Historical files with no available counterpart; the current year may be partial.

    ``observed`` may be a whole trip table: it is reduced map-side to its periods first.
    """
    keys = list(PARTITION_COLUMNS)
    needed = expected.where(F.col("year").isin(list(historical_years)))
    return needed.join(observed.select(*keys).distinct(), keys, "left_anti")


def completeness(
    expected: DataFrame, observed: DataFrame, historical_years: tuple[int, ...]
) -> DataFrame:
    """Per service: expected, present and missing historical files."""
    keys = list(PARTITION_COLUMNS)
    have = observed.select(*keys).distinct().withColumn("present", F.lit(1))
    needed = expected.where(F.col("year").isin(list(historical_years)))
    return (
        needed.join(have, keys, "left")
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("expected_files"),
            F.count("present").alias("present_files"),
        )
        .withColumn("missing_files", F.col("expected_files") - F.col("present_files"))
    )
