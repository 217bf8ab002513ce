"""Zone feature vectors for segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.functions.naming import optional_column, quoted, require_column
from curbflow.operators.series import (
    ZONE_DATE_NAMES,
    ZONE_LABEL_NAMES,
    ZONE_NAMES,
    ZONE_TRIP_NAMES,
    largest_texts,
)

# Feature names, in vector order.
ZONE_FEATURES = (
    "total_trips",
    "avg_daily_trips",
    "demand_stddev",
    "active_days",
    "avg_fare_amount",
    "avg_trip_distance",
    "avg_duration_minutes",
    "total_revenue",
)

# Optional inputs, with candidate names in order of preference.
OPTIONAL_INPUTS = {
    "zone_name": ZONE_LABEL_NAMES,
    "borough": ("borough", "pickup_borough", "borough_name"),
    "days": ("active_days", "observation_days", "days_with_trips"),
    "fare": (
        "avg_fare_amount",
        "average_fare",
        "avg_fare",
        "fare_amount_avg",
        "avg_total_amount",
        "revenue_per_trip",
    ),
    "distance": (
        "avg_trip_distance",
        "average_trip_distance",
        "trip_distance_avg",
        "avg_distance",
    ),
    "duration": (
        "avg_duration_minutes",
        "average_duration_minutes",
        "trip_duration_minutes_avg",
        "avg_trip_duration",
        "avg_trip_duration_minutes",
    ),
    "revenue": ("total_revenue", "revenue", "gross_revenue", "total_amount_sum", "fare_revenue"),
}
_TEXT = ("zone_name", "borough")
_WEIGHTED = ("fare", "distance", "duration")


def trip_weighted(name: str) -> Column:
    """Average of ``name`` weighted by trips, over the rows that know it; 0 where none does."""
    known = F.when(F.col(name).isNotNull(), F.col("trips"))
    weight = F.sum(known)
    return F.coalesce(
        F.when(weight > 0, F.sum(F.col(name) * F.col("trips")) / weight), F.lit(0.0)
    )


def _zone_rows(source: DataFrame) -> DataFrame:
    """Typed rows under fixed names; absent optional inputs are simply not there."""
    chosen = {name: optional_column(source, names) for name, names in OPTIONAL_INPUTS.items()}
    date = optional_column(source, ZONE_DATE_NAMES)
    columns = [
        quoted(require_column(source, ZONE_NAMES, "zone")).cast("string").alias("zone_id"),
        quoted(require_column(source, ZONE_TRIP_NAMES, "trips")).cast("double").alias("trips"),
        *([F.to_date(quoted(date)).alias("date")] if date else []),
        *(
            quoted(physical).cast("string" if name in _TEXT else "double").alias(name)
            for name, physical in chosen.items()
            if physical
        ),
    ]
    return source.select(*columns).where(F.col("zone_id").isNotNull() & (F.col("trips") >= 0))


def zone_day(source: DataFrame) -> DataFrame:
    """Consolidate services: one row per zone and date, so daily statistics count days once."""
    return _consolidate(_zone_rows(source))


def _consolidate(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    days = rows.groupBy("zone_id", "date").agg(
        F.sum("trips").alias("trips"),
        *([F.max("days").alias("days")] if "days" in have else []),
        *(trip_weighted(n).alias(n) for n in _WEIGHTED if n in have),
        *([F.sum(F.coalesce("revenue", F.lit(0.0))).alias("revenue")] if "revenue" in have else []),
    )
    return _named(days, rows)


def _named(zones: DataFrame, rows: DataFrame) -> DataFrame:
    """``zones`` with the texts of their zones, which numeric aggregates leave out."""
    texts = [n for n in _TEXT if n in rows.columns]
    return zones.join(largest_texts(rows, "zone_id", texts), "zone_id", "left") if texts else zones


def zone_features(source: DataFrame) -> DataFrame:
    """Eight features per zone, none of them null."""
    rows = _zone_rows(source)
    if "date" in rows.columns:
        rows = _consolidate(rows)
    have = set(rows.columns)
    if "date" in have:
        active = F.count_distinct("date").cast("double")
    elif "days" in have:
        active = F.max("days")
    else:
        active = F.count(F.lit(1)).cast("double")
    if "revenue" in have:
        revenue = F.sum(F.coalesce("revenue", F.lit(0.0)))
    elif "fare" in have:
        revenue = F.sum(F.coalesce("fare", F.lit(0.0)) * F.col("trips"))
    else:
        revenue = F.lit(0.0)

    def weighted(name: str) -> Column:
        return trip_weighted(name) if name in have else F.lit(0.0)

    features = (
        rows.groupBy("zone_id")
        .agg(
            F.sum("trips").alias("total_trips"),
            F.avg("trips").alias("avg_daily_trips"),
            F.stddev_pop("trips").alias("demand_stddev"),
            active.alias("active_days"),
            weighted("fare").alias("avg_fare_amount"),
            weighted("distance").alias("avg_trip_distance"),
            weighted("duration").alias("avg_duration_minutes"),
            revenue.alias("total_revenue"),
        )
        .fillna(0.0, subset=list(ZONE_FEATURES))
    )
    return _named(features, rows)
