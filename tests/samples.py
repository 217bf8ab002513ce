"""Hand-made rows shared by the tests."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import pandas as pd

START = datetime(2023, 1, 15, 8, 0)
END = datetime(2023, 1, 15, 8, 20)


def yellow(**changes) -> dict:
    row = {
        "VendorID": 1,
        "tpep_pickup_datetime": START,
        "tpep_dropoff_datetime": END,
        "PULocationID": 10,
        "DOLocationID": 20,
        "passenger_count": 1.0,
        "payment_type": 1,
        "trip_distance": 3.5,
        "fare_amount": 15.0,
        "tip_amount": 3.0,
        "total_amount": 18.0,
        "Airport_fee": 0.0,
    }
    return {**row, **changes}


FAMILY_ROWS = {
    "yellow": yellow(),
    "green": {
        "VendorID": 2,
        "lpep_pickup_datetime": START,
        "lpep_dropoff_datetime": END,
        "PUlocationID": 10,
        "DOlocationID": 20,
        "Trip_distance": 4.0,
        "Fare_amount": 17.0,
        "Total_amount": 19.0,
    },
    "fhv": {
        "dispatching_base_num": "B00001",
        "pickup_datetime": START,
        "dropOff_datetime": END,
        "PUlocationID": 10,
        "DOlocationID": 20,
    },
    "fhvhv": {
        "hvfhs_license_num": "HV0003",
        "pickup_datetime": START,
        "dropoff_datetime": END,
        "PULocationID": 10,
        "DOLocationID": 20,
        "trip_miles": 7.0,
        "base_passenger_fare": 20.0,
        "tolls": 2.0,
        "sales_tax": 1.0,
        "tips": 3.0,
    },
}
EXPECTED = {
    "yellow": (3.5, 18.0),
    "green": (4.0, 19.0),
    "fhv": (None, None),
    "fhvhv": (7.0, 26.0),
}

ZONES = [
    (10, "Manhattan", "Central Harlem", "Boro Zone"),
    (20, "Manhattan", "Midtown Center", "Yellow Zone"),
    (30, "Queens", "JFK Airport", "Airports"),
]
ZONE_SCHEMA = "location_id int, borough string, zone string, service_zone string"

MART_TRIPS = [
    yellow(),
    yellow(
        tpep_pickup_datetime=datetime(2023, 1, 15, 17, 0),
        tpep_dropoff_datetime=datetime(2023, 1, 15, 17, 30),
        tip_amount=0.0,
    ),
    yellow(
        tpep_pickup_datetime=datetime(2023, 1, 16, 2, 0),
        tpep_dropoff_datetime=datetime(2023, 1, 16, 2, 45),
        PULocationID=30,
        payment_type=2,
    ),
    yellow(PULocationID=999),
]


def write_month(folder, service: str, year: int, month: int, rows: list[dict]) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{service}_tripdata_{year}-{month:02d}.parquet"
    frame = pd.DataFrame(rows)
    for column in frame.columns:
        if str(frame[column].dtype).startswith("datetime64"):
            frame[column] = frame[column].astype("datetime64[us]")
    frame.to_parquet(path, index=False)
    return str(path)


def daily_series(days: int = 150) -> list[tuple]:
    rows = []
    for offset in range(days):
        day = date(2023, 1, 1) + timedelta(days=offset)
        wave = 12 * math.sin(2 * math.pi * offset / 30)
        dip = -20 if day.weekday() >= 5 else 0
        for service, base in (("yellow", 180), ("green", 95)):
            rows.append((day, service, float(base + 0.3 * offset + dip + wave)))
    return rows


DAILY_SCHEMA = "pickup_date date, service string, trip_count double"


def zone_series(days: int = 150, zones: int = 12) -> list[tuple]:
    rows = []
    for offset in range(days):
        day = date(2023, 1, 1) + timedelta(days=offset)
        for zone in range(1, zones + 1):
            band = (zone - 1) // 3
            level = (20, 60, 140, 300)[band] + zone + (offset % 7) * (band + 1)
            for service, share in (("yellow", 0.6), ("green", 0.4)):
                trips = max(1, int(level * share))
                rows.append(
                    (day, service, zone, f"Zone {zone}", f"Borough {band}", trips,
                     trips * (10.0 + band), 2.0 + band, 8.0 + 2 * band)
                )
    return rows


ZONE_SERIES_SCHEMA = (
    "pickup_date date, service string, pickup_location_id bigint, pickup_zone string, "
    "pickup_borough string, trip_count bigint, total_revenue double, avg_trip_distance double, "
    "avg_trip_duration_minutes double"
)
