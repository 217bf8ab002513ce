"""Daily series: model inputs, gap-free panels, time features, temporal split, forecast errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.functions.calendar import is_weekend
from curbflow.functions.naming import optional_column, quoted, require_column

# Candidate names of the model inputs, in order of preference.
DATE_NAMES = ("trip_date", "pickup_date", "service_date", "date", "day", "pickup_day")
SERVICE_NAMES = ("service_type", "service", "taxi_type", "trip_type", "service_name")
TRIP_NAMES = (
    "trip_count",
    "total_trips",
    "trips",
    "ride_count",
    "num_trips",
    "trips_total",
    "pickup_count",
)
# Zone inputs are resolved in an order of their own.
ZONE_DATE_NAMES = ("trip_date", "pickup_date", "date", "day", "service_date")
ZONE_TRIP_NAMES = (
    "trip_count",
    "total_trips",
    "trips",
    "ride_count",
    "pickup_count",
    "trips_total",
)
ZONE_NAMES = ("zone_id", "location_id", "pickup_zone_id", "pickup_location_id", "pulocationid")
ZONE_LABEL_NAMES = ("zone_name", "zone", "pickup_zone", "location_name")

# Model feature names, in vector order.
TIME_FEATURES = (
    "day_of_week",
    "month",
    "day_of_month",
    "day_of_year",
    "week_of_year",
    "is_weekend",
    "sin_day_of_year",
    "cos_day_of_year",
    "trend_days",
    "lag_1",
    "lag_7",
    "lag_14",
    "lag_28",
    "rolling_mean_7",
    "rolling_mean_28",
)
LAGS = (1, 7, 14, 28)
ROLLING = (7, 28)


def daily_service(source: DataFrame) -> DataFrame:
    """Trips per date and service; a null service is UNKNOWN, an absent column is ALL."""
    service = optional_column(source, SERVICE_NAMES)
    named = source.select(
        F.to_date(quoted(require_column(source, DATE_NAMES, "date"))).alias("trip_date"),
        (
            F.coalesce(quoted(service).cast("string"), F.lit("UNKNOWN"))
            if service
            else F.lit("ALL")
        ).alias("service_type"),
        quoted(require_column(source, TRIP_NAMES, "trips")).cast("double").alias("trip_count"),
    )
    return (
        named.where(F.col("trip_date").isNotNull() & (F.col("trip_count") >= 0))
        .groupBy("trip_date", "service_type")
        .agg(F.sum("trip_count").alias("trip_count"))
    )


def largest_texts(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One row per key with the largest spelling of each text, taken over the distinct rows only."""
    apart = rows.select(key, *names).distinct()
    same = Window.partitionBy(key)
    return apart.select(key, *(F.max(n).over(same).alias(n) for n in names)).distinct()


def zone_daily(source: DataFrame) -> DataFrame:
    """Trips per date and zone over all services; the zone's name is its largest spelling.

    Numbers are summed by hash; names are settled per zone and joined, as text in the aggregate
    would make Spark sort all rows first.
    """
    label = optional_column(source, ZONE_LABEL_NAMES)
    named = source.select(
        F.to_date(quoted(require_column(source, ZONE_DATE_NAMES, "date"))).alias("trip_date"),
        quoted(require_column(source, ZONE_NAMES, "zone")).cast("string").alias("zone_id"),
        quoted(require_column(source, ZONE_TRIP_NAMES, "trips")).cast("double").alias("trip_count"),
        *([quoted(label).cast("string").alias("zone_name")] if label else []),
    ).where(
        F.col("trip_date").isNotNull() & F.col("zone_id").isNotNull() & (F.col("trip_count") >= 0)
    )
    days = named.groupBy("trip_date", "zone_id").agg(F.sum("trip_count").alias("trip_count"))
    return days.join(largest_texts(named, "zone_id", ["zone_name"]), "zone_id", "left") if label else days


def complete_panel(
    frame: DataFrame, *, entity: str, date: str = "trip_date", value: str = "trip_count"
) -> DataFrame:
    """One row for every date between each entity's own first and last, missing values 0."""
    calendar = (
        frame.groupBy(entity)
        .agg(F.min(date).alias("first"), F.max(date).alias("last"))
        .select(entity, F.explode(F.sequence("first", "last")).alias(date))
    )
    filled = calendar.join(frame.select(entity, date, value), [entity, date], "left")
    return filled.withColumn(value, F.coalesce(value, F.lit(0.0)))


def calendar_features(day: Column) -> dict[str, Column]:
    """The features that depend on the date alone; weekday 0 is Sunday."""
    angle = F.lit(2.0 * math.pi) * F.dayofyear(day) / F.lit(365.25)
    return {
        "day_of_week": (F.dayofweek(day) - 1).cast("double"),
        "month": F.month(day).cast("double"),
        "day_of_month": F.dayofmonth(day).cast("double"),
        "day_of_year": F.dayofyear(day).cast("double"),
        "week_of_year": F.weekofyear(day).cast("double"),
        "is_weekend": is_weekend(F.dayofweek(day)).cast("double"),
        "sin_day_of_year": F.sin(angle),
        "cos_day_of_year": F.cos(angle),
    }


def time_features(
    panel: DataFrame, *, entity: str, date: str = "trip_date", value: str = "trip_count"
) -> DataFrame:
    """Calendar, trend, lag and trailing-mean features; a day never sees its own value.

    Window partitions hold one row per calendar day of an entity. The first date is taken as a
    running minimum over the same ordered window, so one shuffle and one sort serve everything.
    """
    days = Window.partitionBy(entity).orderBy(date)
    first = F.min(date).over(days.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return panel.withColumns(
        {
            **calendar_features(F.col(date)),
            "trend_days": F.datediff(date, first).cast("double"),
            **{f"lag_{k}": F.lag(value, k).over(days).cast("double") for k in LAGS},
            **{
                f"rolling_mean_{k}": F.avg(value).over(days.rowsBetween(-k, -1)).cast("double")
                for k in ROLLING
            },
        }
    )


def tag_split(
    frame: DataFrame, *, entity: str, test_days: int, date: str = "trip_date"
) -> DataFrame:
    """Mark each row train or test around its entity's own cutoff date."""
    last = F.max(date).over(Window.partitionBy(entity))
    return frame.withColumn("cutoff_date", F.date_sub(last, test_days)).withColumn(
        "split", F.when(F.col(date) > F.col("cutoff_date"), "test").otherwise("train")
    )


def forecast_errors(
    scored: DataFrame, *, actual: str = "trip_count", predicted: str = "prediction"
) -> DataFrame:
    """All five error measures in a single aggregate; R² = 1 − SSE / total sum of squares."""
    y, error = F.col(actual), F.col(predicted) - F.col(actual)
    sums = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(error * error).alias("sse"),
        F.sum(F.abs(error)).alias("sae"),
        F.sum(F.abs(y)).alias("actual_total"),
        F.var_pop(y).alias("variance"),
        F.avg(F.when(y > 0, F.abs(error) / y)).alias("ape"),
    )
    n = F.col("rows")
    return sums.select(
        "rows",
        F.sqrt(F.col("sse") / n).alias("rmse"),
        (F.col("sae") / n).alias("mae"),
        F.when(F.col("variance") > 0, 1.0 - F.col("sse") / (F.col("variance") * n))
        .otherwise(0.0)
        .alias("r2"),
        (100.0 * F.coalesce("ape", F.lit(0.0))).alias("mape_percent"),
        F.when(F.col("actual_total") > 0, 100.0 * F.col("sae") / F.col("actual_total"))
        .otherwise(0.0)
        .alias("wmape_percent"),
    )


def demand_threshold(train: DataFrame, quantile: float) -> DataFrame:
    """One row: the approximate quantile of positive training counts."""
    return train.where(F.col("trip_count") > 0).agg(
        F.percentile_approx("trip_count", quantile, 10000).cast("double").alias("threshold")
    )


def class_weights(labelled: DataFrame) -> DataFrame:
    """Balanced weight n / (2 · n_class) of each class, from one two-sided count."""
    totals = labelled.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == 1.0).alias("positive")
    )
    sides = F.array(
        F.struct(F.lit(0).alias("label"), (F.col("total") - F.col("positive")).alias("n")),
        F.struct(F.lit(1).alias("label"), F.col("positive").alias("n")),
    )
    return (
        totals.select("total", F.explode(sides).alias("side"))
        .where(F.col("side.n") > 0)
        .select(
            F.col("side.label").alias("label"),
            F.col("side.n").alias("rows"),
            (F.col("total") / (2.0 * F.col("side.n"))).alias("class_weight"),
        )
    )
