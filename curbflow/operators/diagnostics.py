"""Anomaly scores and high-demand labels.

Windows run over marts, never over trips: the daily mart has at most one row per date in each
(service, zone) and the hourly mart one per clock hour, so a window partition is bounded by the
length of the calendar however unevenly trips are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.functions.calendar import is_rush, is_weekend
from curbflow.settings import ANOMALY_THRESHOLD


# A score within half a unit of this decimal of the threshold counts as on it.
SCORE_DIGITS = 9


def _zscore(value: str, mean: str, deviation: str) -> Column:
    return F.when(
        F.col(deviation) > 0, (F.col(value) - F.col(mean)) / F.col(deviation)
    ).otherwise(0.0)


def daily_anomalies(
    daily: DataFrame, threshold: float = ANOMALY_THRESHOLD, digits: int = SCORE_DIGITS
) -> DataFrame:
    """Score each day against its own service, zone and weekday.

    The direction follows demand only: a day flagged for revenue alone reads NORMAL. Scores are
    compared at ``digits`` decimals, so a score exactly on the threshold does not depend on the order
    in which a standard deviation was summed.
    """
    peers = Window.partitionBy("service", "pickup_location_id", "pickup_day_of_week")
    scored = daily.withColumns(
        {
            "baseline_avg_trips": F.avg("trip_count").over(peers),
            "baseline_stddev_trips": F.stddev_pop("trip_count").over(peers),
            "baseline_avg_revenue": F.avg("total_revenue").over(peers),
            "baseline_stddev_revenue": F.stddev_pop("total_revenue").over(peers),
        }
    ).withColumns(
        {
            "demand_zscore": _zscore("trip_count", "baseline_avg_trips", "baseline_stddev_trips"),
            "revenue_zscore": _zscore(
                "total_revenue", "baseline_avg_revenue", "baseline_stddev_revenue"
            ),
        }
    )
    demand, revenue = F.round("demand_zscore", digits), F.round("revenue_zscore", digits)
    return scored.withColumns(
        {
            "is_anomaly": F.greatest(F.abs(demand), F.abs(revenue)) >= threshold,
            "anomaly_direction": F.when(demand >= threshold, "HIGH")
            .when(demand <= -threshold, "LOW")
            .otherwise("NORMAL"),
        }
    )


def demand_labels(hourly: DataFrame, quantile: float = 0.75) -> DataFrame:
    """Label each hour against its zone's own quantile; lag is the previous observed hour.

    Both windows share one partitioning, so the frame is shuffled and sorted once.
    """
    if not 0.0 < quantile < 1.0:
        raise ValueError("quantile must lie strictly between 0 and 1")
    zone = Window.partitionBy("service", "pickup_location_id")
    hours = zone.orderBy("pickup_date", "pickup_hour")
    return hourly.withColumns(
        {
            "previous_observed_trip_count": F.lag("trip_count").over(hours).cast("double"),
            "demand_threshold": F.percentile_approx("trip_count", quantile, 10000)
            .over(zone)
            .cast("double"),
            "is_weekend": is_weekend(F.col("pickup_day_of_week")).cast("int"),
            "is_rush_hour": is_rush(F.col("pickup_hour")).cast("int"),
        }
    ).withColumns(
        {
            "label_high_demand": (F.col("trip_count") >= F.col("demand_threshold")).cast("int"),
            "label": (F.col("trip_count") >= F.col("demand_threshold")).cast("double"),
        }
    )
