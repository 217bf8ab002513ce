"""Eight explainable quality rules, the Silver contract and the valid/invalid split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.schema import OPTIONAL_SILVER, REQUIRED_SILVER
from curbflow.settings import QualityLimits

# Flag column -> rule code, in reporting order.
RULE_CODES = {
    "dq_pickup_datetime_valid": "PICKUP_DATETIME",
    "dq_dropoff_datetime_valid": "DROPOFF_DATETIME",
    "dq_period_valid": "PICKUP_OUTSIDE_FILE_PERIOD",
    "dq_duration_valid": "TRIP_DURATION",
    "dq_pickup_location_valid": "PICKUP_LOCATION",
    "dq_dropoff_location_valid": "DROPOFF_LOCATION",
    "dq_distance_valid": "TRIP_DISTANCE",
    "dq_total_amount_valid": "TOTAL_AMOUNT",
}


def quality_flags(limits: QualityLimits = QualityLimits()) -> dict[str, str]:
    """Flag -> SQL condition. A rule over a null value fails; it is never unknown."""
    priced = "service <> 'fhv'"  # that family publishes neither distance nor fare
    located = "BETWEEN {0.location_min} AND {0.location_max}".format(limits)
    conditions = {
        "dq_pickup_datetime_valid": "pickup_datetime IS NOT NULL",
        "dq_dropoff_datetime_valid": "dropoff_datetime IS NOT NULL",
        "dq_period_valid": "year(pickup_datetime) = year AND month(pickup_datetime) = month",
        "dq_duration_valid": "trip_duration_minutes > 0 "
        f"AND trip_duration_minutes <= {limits.max_duration_minutes}D",
        "dq_pickup_location_valid": f"pickup_location_id {located}",
        "dq_dropoff_location_valid": f"dropoff_location_id {located}",
        "dq_distance_valid": f"NOT ({priced}) "
        f"OR trip_distance BETWEEN 0 AND {limits.max_distance_miles}D",
        "dq_total_amount_valid": f"NOT ({priced}) "
        f"OR abs(total_amount) <= {limits.max_total_amount}D",
    }
    return {flag: f"coalesce({condition}, false)" for flag, condition in conditions.items()}


def with_quality(trips: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Add the eight flags, the ordered list of failed rules, its size and the verdict."""
    flagged = trips.selectExpr("*", *(f"{c} AS {f}" for f, c in quality_flags(limits).items()))
    codes = ", ".join(f"CASE WHEN NOT {flag} THEN '{code}' END" for flag, code in RULE_CODES.items())
    listed = flagged.selectExpr(
        "*", f"array_compact(array({codes})) AS dq_errors", f"{' AND '.join(RULE_CODES)} AS dq_valid"
    )
    return listed.selectExpr("*", "size(dq_errors) AS dq_error_count")


def silver_contract(df: DataFrame) -> DataFrame:
    """Check the columns marts cannot do without; add missing optional ones as typed nulls."""
    missing = sorted(set(REQUIRED_SILVER) - set(df.columns))
    if missing:
        raise ValueError(f"Silver lacks required columns: {', '.join(missing)}")
    absent = {
        name: F.lit(None).cast(dtype)
        for name, dtype in OPTIONAL_SILVER.items()
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def valid_only(silver: DataFrame) -> DataFrame:
    """A bare boolean filter: an unknown verdict is not valid, and the scan can push it down."""
    return silver.filter("dq_valid")


def invalid_only(silver: DataFrame) -> DataFrame:
    return silver.filter("NOT dq_valid OR dq_valid IS NULL")


def rule_failures(silver: DataFrame) -> DataFrame:
    """Failures per rule and file."""
    return (
        silver.select("service", "year", "month", F.explode("dq_errors").alias("rule"))
        .groupBy("service", "year", "month", "rule")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def quality_counts(silver: DataFrame) -> DataFrame:
    """Rows, valid and invalid rows per file."""
    return silver.groupBy("service", "year", "month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("dq_valid").alias("valid_rows"),
        F.count_if(~F.col("dq_valid")).alias("invalid_rows"),
    )
