"""Trip-shaped view over the driver tables: one trip per line item, in four raw families.

The view stands in for monthly trip files. It plants faults for every quality rule and uses
whole and quarter fractions, so sums of doubles are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

from curbflow.functions.text import trip_filename
from curbflow.operators import marts
from curbflow.operators.canonical import canonical_trips
from curbflow.operators.quality import valid_only, with_quality
from curbflow.operators.zones import canonical_zones, enrich_trips
from curbflow.schema import PARTITION_COLUMNS
from curbflow.session import scratch_path
from curbflow.settings import SERVICES
from curbflow.sources.sinks import delete_path, open_writers, path_exists, rebalanced


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Neutral column -> SQL over line item, order, customer and supplier.
DAY0 = (
    "date_add(DATE'2023-01-01', "
    "CAST(datediff(CAST(o_orderdate AS date), DATE'1995-01-01') % 180 AS int))"
)
LENGTH = (
    "CASE WHEN l_partkey % 83 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN -5 "
    "WHEN l_partkey % 79 = 0 THEN 2000 ELSE CAST(l_quantity AS int) END"
)
START = (
    "CAST(unix_date(day0) AS bigint) * 86400 + CASE WHEN l_partkey % 97 = 0 THEN 31 * 86400 ELSE 0 END"
    " + ((l_orderkey * 37 + l_linenumber * 11) % 1440) * 60"
)
FAMILY = (
    "CASE l_orderkey % 4 WHEN 0 THEN 'yellow' WHEN 1 THEN 'green' WHEN 2 THEN 'fhv' ELSE 'fhvhv' END"
)
# What a line item says without its order; computed before the join, so that narrow rows are shuffled.
LINE = {
    "l_orderkey": "l_orderkey",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
    "l_linenumber": "l_linenumber",
    "l_quantity": "l_quantity",
    "whole": "whole",
    "tip": "floor(whole * l_discount * 4) / 4D",
    "tax": "floor(whole * l_tax * 4) / 4D",
}
FACTS = {
    "family": "family",
    "file_year": "2023",
    "file_month": "file_month",
    "began": "timestamp_seconds(start)",
    "ended": "timestamp_seconds(start + length * 60)",
    "requested": "timestamp_seconds(start - 300)",
    "seconds": "CAST(length * 60 AS bigint)",
    "origin": "CASE WHEN l_partkey % 101 = 0 THEN 999 ELSE s_nationkey + 1 END",
    "destination": "CASE WHEN l_partkey % 103 = 0 THEN NULL ELSE c_nationkey + 1 END",
    "miles": "CASE WHEN l_partkey % 107 = 0 THEN 600D ELSE l_quantity / 4 END",
    "fare": "whole",
    "tip": "tip",
    "tax": "tax",
    "tolls": "CASE WHEN l_partkey % 109 = 0 THEN 20000D ELSE 0D END",
    "payment": "l_linenumber % 6 + 1",
    "riders": "l_linenumber",
    "extra": "(l_linenumber % 3) * 0.5D",
    "congestion": "CASE WHEN l_linenumber % 2 = 1 THEN 2.75D END",
    "vendor": "l_suppkey % 2 + 1",
    "base": "format_string('B%05d', l_suppkey)",
}
GATHERED = ("family", "file_month")


def trip_facts(spark: SparkSession, sf_dir: str, *gathered: str) -> DataFrame:
    """Line items joined to their order, customer and supplier under neutral names.

    Day arithmetic is done on orders before the join: once per order, not once per line. Customers
    join the orders, so that lines are shuffled for their order only. Rows that are to be
    ``gathered`` by partition keys for a write are so while they are narrow: before names,
    timestamps and everything else that follows from a line is computed.
    """
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "CAST(floor(l_extendedprice / 1000) AS double) AS whole"
    ).selectExpr(*(f"{text} AS {name}" for name, text in LINE.items()))
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", f"{DAY0} AS day0"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    dated = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", "day0", "c_nationkey"
    )
    joined = (
        items.join(dated, items.l_orderkey == dated.o_orderkey)
        .join(suppliers, items.l_suppkey == suppliers.s_suppkey)
        .selectExpr(*LINE, "day0", "c_nationkey", "s_nationkey", f"{FAMILY} AS family", "month(day0) AS file_month")
    )
    lines = rebalanced(joined, gathered) if gathered else joined
    return lines.selectExpr("*", f"{START} AS start", f"{LENGTH} AS length").selectExpr(
        *(f"{text} AS {name}" for name, text in FACTS.items())
    )


# Raw column of each family -> neutral column, with the spellings the families publish.
RAW_COLUMNS: dict[str, dict[str, str]] = {
    "yellow": {
        "VendorID": "vendor",
        "tpep_pickup_datetime": "began",
        "tpep_dropoff_datetime": "ended",
        "PULocationID": "origin",
        "DOLocationID": "destination",
        "passenger_count": "riders",
        "trip_distance": "miles",
        "payment_type": "payment",
        "fare_amount": "fare",
        "extra": "extra",
        "tip_amount": "tip",
        "tolls_amount": "tolls",
        "total_amount": "source_total",
    },
    "green": {
        "VendorID": "vendor",
        "lpep_pickup_datetime": "began",
        "lpep_dropoff_datetime": "ended",
        "PUlocationID": "origin",
        "DOlocationID": "destination",
        "passenger_count": "riders",
        "Trip_distance": "miles",
        "Payment_type": "payment",
        "Fare_amount": "fare",
        "Extra": "extra",
        "Tip_amount": "tip",
        "Tolls_amount": "tolls",
        "Total_amount": "source_total",
    },
    "fhv": {
        "dispatching_base_num": "base",
        "pickup_datetime": "began",
        "dropOff_datetime": "ended",
        "PUlocationID": "origin",
        "DOlocationID": "destination",
        "payment_type": "payment",
    },
    "fhvhv": {
        "hvfhs_license_num": "base",
        "request_datetime": "requested",
        "pickup_datetime": "began",
        "dropoff_datetime": "ended",
        "PULocationID": "origin",
        "DOLocationID": "destination",
        "trip_miles": "miles",
        "trip_time": "seconds",
        "payment_type": "payment",
        "base_passenger_fare": "fare",
        "tolls": "tolls",
        "sales_tax": "tax",
        "congestion_surcharge": "congestion",
        "tips": "tip",
    },
}
PERIOD = ("family", "file_year", "file_month")


SOURCE_TOTAL = "fare + tip + tolls"


def _source(name: str) -> str:
    return SOURCE_TOTAL if name == "source_total" else name


def family_frame(facts: DataFrame, family: str) -> DataFrame:
    """The raw frame of one family, under that family's own column names."""
    return facts.where(f"family = '{family}'").selectExpr(
        *PERIOD, *(f"{_source(src)} AS {raw}" for raw, src in RAW_COLUMNS[family].items())
    )


def family_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips written once, a folder a family and month, so that a family's frame, or one of its
    months, reads its own files."""
    return written(spark, sf_dir, "families", lambda: trip_facts(spark, sf_dir, *GATHERED), *GATHERED, gathered=True)


def mixed_frame(facts: DataFrame) -> DataFrame:
    """All families side by side from one scan; a row fills only its own family's columns."""
    spelled: dict[str, tuple[str, str, list[str]]] = {}
    for family, columns in RAW_COLUMNS.items():
        for raw, src in columns.items():
            _, known, families = spelled.setdefault(raw.lower(), (raw, src, []))
            if known != src:
                raise ValueError(f"{raw} means two things")
            families.append(f"'{family}'")
    return facts.selectExpr(
        *PERIOD,
        *(
            f"{_source(src)} AS {raw}"
            if len(families) == len(SERVICES)
            else f"CASE WHEN family IN ({', '.join(families)}) THEN {_source(src)} END AS {raw}"
            for raw, src, families in spelled.values()
        ),
    )


def canonical_family(facts: DataFrame, family: str) -> DataFrame:
    return canonical_trips(
        family_frame(facts, family),
        service=family,
        year="file_year",
        month="file_month",
        source_file=trip_filename("family", "file_year", "file_month"),
    )


def scored_trips(spark: SparkSession, sf_dir: str, *gathered: str) -> DataFrame:
    """Canonical trips of all families with their quality verdict, from one scan of the tables."""
    return with_quality(
        canonical_trips(
            mixed_frame(trip_facts(spark, sf_dir, *gathered)),
            service_column="family",
            year="file_year",
            month="file_month",
            source_file=trip_filename("family", "file_year", "file_month"),
        )
    )


# Layers the workload has written, by (application, directory, layer).
_WRITTEN: dict[tuple[str, str, str], str] = {}
_WRITING = RLock()  # building one layer may read another


def written(
    spark: SparkSession, sf_dir: str, layer: str, build: Callable[[], DataFrame], *keys: str, gathered: bool = False
) -> DataFrame:
    """Write a layer to the shared folder once per session and read it back from there.

    Silver and Gold are tables in a medallion lake: everything downstream prunes columns and
    partitions of a written table instead of repeating the joins above it. The folder belongs to
    this session, so nothing stale survives, and a lost executor loses no data. Rows that come
    ``gathered`` by their partition are not shuffled for it again. A task then holds few partitions
    and keeps their files open; sorting its wide rows by partition took memory that grew with them.
    """
    slot = (spark.sparkContext.applicationId, sf_dir, layer)
    with _WRITING:
        if slot not in _WRITTEN or not path_exists(spark, f"{_WRITTEN[slot]}/_SUCCESS"):
            path = scratch_path(spark, layer)
            layer_rows = build()
            if keys:
                rows = layer_rows if gathered else rebalanced(layer_rows, keys)
                with open_writers(spark):
                    rows.write.partitionBy(*keys).parquet(path)
            else:
                layer_rows.write.parquet(path)
            _WRITTEN[slot] = path
    return spark.read.parquet(_WRITTEN[slot])


def drop_layers(spark: SparkSession) -> int:
    """Remove the layers this session has written; the next query would write them again."""
    own = [slot for slot in _WRITTEN if slot[0] == spark.sparkContext.applicationId]
    return sum(delete_path(spark, _WRITTEN.pop(slot)) for slot in own)


def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as a written table: its size is known, where that of a join is only guessed, as a product,
    and trips would be shuffled to meet 25 rows."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    both = nations.join(regions, nations.n_regionkey == regions.r_regionkey).selectExpr(
        "CAST(n_nationkey + 1 AS string) AS LocationID",
        "r_name AS Borough",
        "n_name AS Zone",
        "r_name AS service_zone",
    )
    return written(spark, sf_dir, "zones", lambda: canonical_zones(both).coalesce(1))


def silver_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(
        spark, sf_dir, "silver", lambda: scored_trips(spark, sf_dir, *GATHERED), *PARTITION_COLUMNS, gathered=True
    )


def enriched_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_trips(valid_only(silver_trips(spark, sf_dir)), zone_lookup(spark, sf_dir))


BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "daily": marts.daily_demand,
    "hourly": marts.hourly_profile,
    "finance": marts.service_financials,
    "routes": marts.route_performance,
    "route_base": marts.route_base,
    "tips": marts.tip_factors,
}


def mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base mart, written once per session for the queries that build on it."""
    return written(
        spark,
        sf_dir,
        name,
        lambda: BUILDERS[name](enriched_trips(spark, sf_dir)),
        "pickup_year",
        "pickup_month",
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as audit events; ``details`` stays JSON text."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS string) AS event_id",
        "event_type",
        "CASE user_id % 3 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'OK' ELSE 'FAILED' END AS status",
        "CAST(ts AS timestamp) AS timestamp_utc",
        "CAST(user_id AS string) AS run_id",
        "props AS details",
    )
