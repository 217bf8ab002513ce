"""The canonical trip: its columns, types and historical spellings.

Fixed values: names, types and aliases are stated as the published data dictionaries use them.
"""

from __future__ import annotations

from typing import NamedTuple


class Target(NamedTuple):
    name: str
    dtype: str
    aliases: tuple[str, ...]


def _same(name: str, dtype: str) -> Target:
    return Target(name, dtype, (name,))


PICKUP_ALIASES = {
    "yellow": ("tpep_pickup_datetime", "pickup_datetime"),
    "green": ("lpep_pickup_datetime", "pickup_datetime"),
    "fhv": ("pickup_datetime",),
    "fhvhv": ("pickup_datetime",),
}
DROPOFF_ALIASES = {
    "yellow": ("tpep_dropoff_datetime", "dropoff_datetime"),
    "green": ("lpep_dropoff_datetime", "dropoff_datetime"),
    "fhv": ("dropoff_datetime",),
    "fhvhv": ("dropoff_datetime",),
}

TRIP_TARGETS = (
    _same("request_datetime", "timestamp"),
    _same("on_scene_datetime", "timestamp"),
    _same("vendor_id", "int"),
    _same("hvfhs_license_num", "string"),
    _same("dispatching_base_num", "string"),
    _same("originating_base_num", "string"),
    Target("affiliated_base_number", "string", ("affiliated_base_number", "affiliated_base_num")),
    Target("pickup_location_id", "int", ("pu_location_id",)),
    Target("dropoff_location_id", "int", ("do_location_id",)),
    _same("passenger_count", "int"),
    Target("trip_distance", "double", ("trip_distance", "trip_miles")),
    Target("reported_trip_time_seconds", "bigint", ("trip_time",)),
    _same("rate_code_id", "int"),
    _same("store_and_fwd_flag", "string"),
    _same("payment_type", "int"),
    _same("trip_type", "int"),
    _same("fare_amount", "double"),
    _same("base_passenger_fare", "double"),
    _same("extra", "double"),
    _same("mta_tax", "double"),
    Target("tip_amount", "double", ("tip_amount", "tips")),
    Target("tolls_amount", "double", ("tolls_amount", "tolls")),
    _same("ehail_fee", "double"),
    _same("improvement_surcharge", "double"),
    _same("total_amount", "double"),
    _same("congestion_surcharge", "double"),
    _same("airport_fee", "double"),
    _same("cbd_congestion_fee", "double"),
    _same("bcf", "double"),
    _same("sales_tax", "double"),
    _same("driver_pay", "double"),
    _same("shared_request_flag", "string"),
    _same("shared_match_flag", "string"),
    _same("access_a_ride_flag", "string"),
    _same("wav_request_flag", "string"),
    _same("wav_match_flag", "string"),
    Target("shared_ride_flag", "string", ("sr_flag", "shared_ride_flag")),
)

# Parts a missing total is rebuilt from; driver pay is not one of them.
TOTAL_PARTS = (
    "base_passenger_fare",
    "tolls_amount",
    "bcf",
    "sales_tax",
    "congestion_surcharge",
    "airport_fee",
    "cbd_congestion_fee",
    "tip_amount",
)

TAX_PARTS = (
    "extra",
    "mta_tax",
    "improvement_surcharge",
    "congestion_surcharge",
    "airport_fee",
    "cbd_congestion_fee",
    "bcf",
    "sales_tax",
)

REQUIRED_SILVER = (
    "service",
    "year",
    "month",
    "pickup_datetime",
    "dropoff_datetime",
    "pickup_location_id",
    "dropoff_location_id",
    "dq_valid",
)

OPTIONAL_SILVER = {
    "passenger_count": "int",
    "trip_distance": "double",
    "trip_duration_minutes": "double",
    "payment_type": "int",
    "fare_amount": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "total_amount": "double",
    **{name: "double" for name in TAX_PARTS},
}

PARTITION_COLUMNS = ("service", "year", "month")
