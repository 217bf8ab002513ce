"""Zone dimension and its two roles on a trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.naming import quoted_sql, require_column

UNKNOWN = "Unknown"
LABELS = ("borough", "zone", "service_zone")


def canonical_zones(raw: DataFrame) -> DataFrame:
    """Typed lookup with one row per zone.

    Several rows under one id are settled by the smallest (borough, zone, service_zone), so the
    answer does not depend on the order in which files are read.
    """
    key = quoted_sql(require_column(raw, ("location_id",), "zone id"))
    named = raw.selectExpr(
        f"try_cast({key} AS int) AS location_id",
        *(
            f"CAST({quoted_sql(require_column(raw, (name,), name))} AS string) AS {name}"
            for name in LABELS
        ),
    )
    return (
        named.where("location_id IS NOT NULL")
        .groupBy("location_id")
        .agg(F.min(F.struct(*LABELS)).alias("names"))
        .select("location_id", "names.*")
    )


def attach_zone(trips: DataFrame, zones: DataFrame, role: str) -> DataFrame:
    """Left join in one role (``pickup`` or ``dropoff``); unmatched trips read ``Unknown``.

    Read the lookup from a file or table, so that its size is known. No broadcast hint: Catalyst and adaptive execution broadcast the lookup while its measured
    size is below the session's threshold and fall back to a skew-aware sort-merge join above it.
    """
    key = f"_{role}_zone_key"
    labels = zones.selectExpr(
        f"location_id AS {key}", *(f"{name} AS {role}_{name}" for name in LABELS)
    )
    joined = trips.join(labels, trips[f"{role}_location_id"] == labels[key], "left")
    return joined.selectExpr(
        *trips.columns,
        *(f"coalesce({role}_{name}, '{UNKNOWN}') AS {role}_{name}" for name in LABELS),
    )


def enrich_trips(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return attach_zone(attach_zone(trips, zones, "pickup"), zones, "dropoff")
