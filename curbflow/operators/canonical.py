"""Any family's raw trips -> the canonical trip, one row for one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from curbflow.functions.naming import typed_sql
from curbflow.schema import DROPOFF_ALIASES, PICKUP_ALIASES, TOTAL_PARTS, TRIP_TARGETS
from curbflow.settings import SERVICES


def minutes_between(start: str, end: str) -> str:
    return f"(CAST({end} AS bigint) - CAST({start} AS bigint)) / 60.0D"


def sum_present_sql(parts: Sequence[str]) -> str:
    """Row-wise sum that treats null parts as 0 but is null when every part is null."""
    total = " + ".join(f"coalesce({part}, 0D)" for part in parts)
    return f"CASE WHEN coalesce({', '.join(parts)}) IS NOT NULL THEN {total} END"


def _merged(aliases: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(alias for service in SERVICES for alias in aliases[service]))


def canonical_trips(
    raw: DataFrame,
    *,
    year: str | int,
    month: str | int,
    service: str | None = None,
    service_column: str | None = None,
    source_file: str = "NULL",
    source_path: str = "NULL",
) -> DataFrame:
    """Project raw trips onto the canonical schema; never filters, deduplicates or samples.

    ``year``, ``month``, ``source_file`` and ``source_path`` are SQL expressions, so a whole family
    is read in one scan with the period taken from each row's own file name. Name one ``service``,
    or the ``service_column`` of a frame that holds several families side by side.
    """
    if (service is None) == (service_column is None):
        raise ValueError("name either a service or a service column")
    if service is not None and service.casefold() not in SERVICES:
        raise ValueError(f"unknown service: {service}")
    mixed = service is None
    family = service_column if mixed else f"'{service.casefold()}'"
    pickup = _merged(PICKUP_ALIASES) if mixed else PICKUP_ALIASES[service.casefold()]
    dropoff = _merged(DROPOFF_ALIASES) if mixed else DROPOFF_ALIASES[service.casefold()]
    columns = raw.columns

    def aliased(name: str, dtype: str, aliases: Sequence[str]) -> str:
        return f"{typed_sql(columns, aliases, dtype, per_row=mixed)} AS {name}"

    resolved = raw.selectExpr(
        f"CAST({source_file} AS string) AS source_file",
        f"CAST({source_path} AS string) AS source_path",
        f"CAST({family} AS string) AS service",
        f"CAST({year} AS int) AS year",
        f"CAST({month} AS int) AS month",
        aliased("pickup_datetime", "timestamp", pickup),
        aliased("dropoff_datetime", "timestamp", dropoff),
        *(aliased(t.name, t.dtype, t.aliases) for t in TRIP_TARGETS),
    )
    derived = {
        "fare_amount": "coalesce(fare_amount, base_passenger_fare)",
        "total_amount": f"coalesce(total_amount, {sum_present_sql(TOTAL_PARTS)})",
    }
    return resolved.selectExpr(
        *(f"{derived[c]} AS {c}" if c in derived else c for c in resolved.columns),
        f"{minutes_between('pickup_datetime', 'dropoff_datetime')} AS trip_duration_minutes",
    )
