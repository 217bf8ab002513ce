"""Star joins: every fact left-joined to the dimensions it relates to.

All joins are many-to-one, so a fact keeps its row count; a fact without a matching member keeps
a null one. Dimensions are joined without hints: they are small enough for Catalyst's own size
check, and a zone or cluster table that outgrows it gets a skew-aware sort-merge join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.calendar import month_start

# Role -> (dimension, its key, attribute columns carried into the star).
ROLES = {
    "date": ("date", "date", ("year", "month_name", "quarter", "year_month", "weekday_name")),
    "service": ("service", "service", ("service_name",)),
    "origin": ("zone", "location_id", ("borough", "zone", "service_zone")),
    "destination": ("zone", "location_id", ("borough", "zone", "service_zone")),
    "payment": ("payment", "payment_type", ("payment_name",)),
    "hour": ("hour", "hour", ("hour_band", "is_rush_hour")),
    "cluster": ("cluster", "segment_id", ("segment_name",)),
}


@dataclass(frozen=True)
class Fact:
    """Role -> column of the fact that points at it."""

    links: dict[str, str]
    monthly: bool = False


FACTS = {
    "demand": Fact({"date": "pickup_date", "service": "service", "origin": "pickup_location_id"}),
    "hourly": Fact(
        {
            "date": "pickup_date",
            "service": "service",
            "origin": "pickup_location_id",
            "hour": "pickup_hour",
        }
    ),
    "finance": Fact(
        {"date": "month_start", "service": "service", "payment": "payment_type"}, monthly=True
    ),
    "routes": Fact(
        {
            "date": "month_start",
            "service": "service",
            "origin": "pickup_location_id",
            "destination": "dropoff_location_id",
        },
        monthly=True,
    ),
    "tips": Fact(
        {
            "date": "month_start",
            "service": "service",
            "payment": "payment_type",
            "hour": "pickup_hour",
        },
        monthly=True,
    ),
    "anomalies": Fact(
        {"date": "pickup_date", "service": "service", "origin": "pickup_location_id"}
    ),
    "forecast": Fact({"date": "forecast_date", "service": "service"}),
    "segments": Fact({"origin": "pickup_location_id", "cluster": "segment_id"}),
    "classification": Fact({"date": "prediction_date", "origin": "pickup_location_id"}),
    "profiles": Fact({"cluster": "segment_id"}),
    "forecast_metrics": Fact({}),
    "segment_metrics": Fact({}),
    "confusion": Fact({}),
    "classification_metrics": Fact({}),
    "model_metrics": Fact({}),
}


def with_month_start(fact: DataFrame) -> DataFrame:
    return fact.withColumn("month_start", month_start(F.col("pickup_year"), F.col("pickup_month")))


def attribute(role: str, name: str) -> str:
    """Name an attribute takes in the star, unambiguous across roles."""
    return f"{role}_{name}"


def star_join(fact: DataFrame, spec: Fact, dimensions: dict[str, DataFrame]) -> DataFrame:
    star = with_month_start(fact) if spec.monthly else fact
    for role, link in spec.links.items():
        dimension, key, attributes = ROLES[role]
        side = dimensions[dimension].selectExpr(
            f"{key} AS _{role}_key", *(f"{a} AS {attribute(role, a)}" for a in attributes)
        )
        star = star.join(side, star[link] == side[f"_{role}_key"], "left").drop(f"_{role}_key")
    return star


def relationship_count() -> int:
    return sum(len(fact.links) for fact in FACTS.values())
