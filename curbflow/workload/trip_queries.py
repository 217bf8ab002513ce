"""Row-level queries: canonical projection, quality, enrichment, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.calendar import calendar_columns, is_night, is_rush, is_weekend
from curbflow.functions.naming import typed_sql
from curbflow.functions.text import file_id, normalise_text, route_label
from curbflow.operators.canonical import minutes_between, sum_present_sql
from curbflow.operators.quality import (
    RULE_CODES,
    invalid_only,
    quality_counts,
    rule_failures,
    silver_contract,
    valid_only,
    with_quality,
)
from curbflow.operators.reconcile import reconcile_counts, reconcile_total
from curbflow.operators.zones import enrich_trips
from curbflow.schema import TRIP_TARGETS
from curbflow.settings import SERVICES
from curbflow.workload.oracle_base import sql
from curbflow.workload.registry import query, stamp, stamp_sql
from curbflow.workload.trips import (
    canonical_family,
    enriched_trips,
    family_files,
    family_frame,
    scored_trips,
    silver_trips,
    table,
    trip_facts,
    zone_lookup,
)

MOMENTS = ("pickup_datetime", "dropoff_datetime", "request_datetime", "on_scene_datetime")
# Canonical columns the trip view leaves null in every family.
NEVER_FILLED = tuple(
    t
    for t in TRIP_TARGETS
    if t.name
    in {
        "originating_base_num", "affiliated_base_number", "rate_code_id", "store_and_fwd_flag",
        "trip_type", "mta_tax", "ehail_fee", "improvement_surcharge", "airport_fee",
        "cbd_congestion_fee", "bcf", "driver_pay", "shared_request_flag", "shared_match_flag",
        "access_a_ride_flag", "wav_request_flag", "wav_match_flag", "shared_ride_flag",
    }
)
_NULLS = ", ".join(
    f"CAST(NULL AS {t.dtype.replace('string', 'VARCHAR')}) AS {t.name}" for t in NEVER_FILLED
)
_CANONICAL_SQL = f"""
SELECT * REPLACE (CAST(vendor_id AS INTEGER) AS vendor_id, {", ".join(stamp_sql(m) for m in MOMENTS[:3])}),
  CAST(NULL AS VARCHAR) AS on_scene_datetime, CAST(NULL AS VARCHAR) AS source_path, {_NULLS}
FROM canonical
"""


def _readable(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.date_format(m, "yyyy-MM-dd HH:mm:ss") for m in MOMENTS})


def _register_family(family: str) -> None:
    @query(f"canonical_{family}", sql(f"{_CANONICAL_SQL} WHERE service = '{family}'", "canonical"))
    def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _readable(canonical_family(trip_facts(spark, sf_dir), family))


for _family in SERVICES:
    _register_family(_family)


@query("silver_union", sql(f"""
SELECT service, month, source_file, count(*) AS trips, count(total_amount) AS priced,
  sum(coalesce(total_amount, 0)) AS amount, count(trip_distance) AS measured,
  CAST(sum(dq_error_count) AS BIGINT) AS failures
FROM silver GROUP BY ALL
""", "silver"))
def silver_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four families written as their own files, canonicalised apart, united by name, then
    summarised per file. The joins above the files run once, for all four."""
    facts = family_files(spark, sf_dir)
    united = reduce(DataFrame.unionByName, (canonical_family(facts, f) for f in SERVICES))
    return (
        with_quality(united)
        .groupBy("service", "month", "source_file")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.count("total_amount").alias("priced"),
            F.sum(F.coalesce("total_amount", F.lit(0.0))).alias("amount"),
            F.count("trip_distance").alias("measured"),
            F.sum("dq_error_count").alias("failures"),
        )
    )


@query("resolve_aliases", sql("""
SELECT service, count(pickup_location_id) AS with_origin, count(dropoff_location_id) AS with_destination,
  count(trip_distance) AS with_distance, count(tip_amount) AS with_tip, count(tolls_amount) AS with_tolls,
  CAST(0 AS BIGINT) AS with_airport_fee, sum(coalesce(trip_distance, 0)) AS distance
FROM canonical GROUP BY ALL
""", "canonical"))
def resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases resolved per family by folded name; an alias nobody has becomes a typed null."""
    facts = family_files(spark, sf_dir)
    wanted = {
        "pickup_location_id": (("pu_location_id", "pulocationid"), "int"),
        "dropoff_location_id": (("do_location_id", "dolocationid"), "int"),
        "trip_distance": (("trip_distance", "trip_miles"), "double"),
        "tip_amount": (("tip_amount", "tips"), "double"),
        "tolls_amount": (("tolls_amount", "tolls"), "double"),
        "airport_fee": (("airport_fee",), "double"),
    }
    parts = []
    for family in SERVICES:
        raw = family_frame(facts, family)
        parts.append(
            raw.selectExpr(
                f"'{family}' AS service",
                *(f"{typed_sql(raw.columns, a, t)} AS {name}" for name, (a, t) in wanted.items()),
            )
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("service")
        .agg(
            F.count("pickup_location_id").alias("with_origin"),
            F.count("dropoff_location_id").alias("with_destination"),
            F.count("trip_distance").alias("with_distance"),
            F.count("tip_amount").alias("with_tip"),
            F.count("tolls_amount").alias("with_tolls"),
            F.count("airport_fee").alias("with_airport_fee"),
            F.sum(F.coalesce("trip_distance", F.lit(0.0))).alias("distance"),
        )
    )


@query("total_fallback", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN base IS NOT NULL OR toll IS NOT NULL OR tax IS NOT NULL OR tip IS NOT NULL
       THEN coalesce(base, 0) + coalesce(toll, 0) + coalesce(tax, 0) + coalesce(tip, 0) END AS total_amount
FROM (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_partkey % 2 = 0 THEN floor(l_extendedprice / 1000) END AS base,
    CASE WHEN l_partkey % 3 = 0 THEN l_quantity / 4 END AS toll,
    CASE WHEN l_partkey % 5 = 0 THEN l_quantity / 2 END AS tax,
    CASE WHEN l_partkey % 7 = 0 THEN l_quantity END AS tip
  FROM lineitem
)
""")
def total_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-aware total with every combination of missing parts; null when all are missing."""
    parts = {
        "base": "CASE WHEN l_partkey % 2 = 0 THEN CAST(floor(l_extendedprice / 1000) AS double) END",
        "toll": "CASE WHEN l_partkey % 3 = 0 THEN l_quantity / 4 END",
        "tax": "CASE WHEN l_partkey % 5 = 0 THEN l_quantity / 2 END",
        "tip": "CASE WHEN l_partkey % 7 = 0 THEN l_quantity END",
    }
    key = ("l_orderkey", "l_linenumber", "l_partkey")
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(*key, *(f"{text} AS {name}" for name, text in parts.items()))
        .selectExpr(*key, f"{sum_present_sql(list(parts))} AS total_amount")
    )


@query("trip_duration", """
SELECT l_orderkey, l_linenumber, date_diff('second', CAST(o_orderdate AS TIMESTAMP), CAST(l_shipdate AS TIMESTAMP)) / 60.0::DOUBLE AS minutes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def trip_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .selectExpr(
            "l_orderkey",
            "l_linenumber",
            "CAST(o_orderdate AS timestamp) AS start",
            "CAST(l_shipdate AS timestamp) AS end",
        )
        .selectExpr("l_orderkey", "l_linenumber", f"{minutes_between('start', 'end')} AS minutes")
    )


_TRIP_KEY = ("service", "source_file", "pickup_location_id", "dropoff_location_id")
_TRIP_KEY_SQL = ", ".join(_TRIP_KEY)


@query("dq_flags", sql(f"""
SELECT {_TRIP_KEY_SQL}, {stamp_sql("pickup_datetime")},
  e1 IS NULL AS dq_pickup_datetime_valid, e2 IS NULL AS dq_dropoff_datetime_valid,
  e3 IS NULL AS dq_period_valid, e4 IS NULL AS dq_duration_valid,
  e5 IS NULL AS dq_pickup_location_valid, e6 IS NULL AS dq_dropoff_location_valid,
  e7 IS NULL AS dq_distance_valid, e8 IS NULL AS dq_total_amount_valid
FROM silver
""", "silver"))
def dq_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_trips(spark, sf_dir).select(*_TRIP_KEY, stamp("pickup_datetime"), *RULE_CODES)


@query("dq_errors", sql(f"""
SELECT {_TRIP_KEY_SQL}, {stamp_sql("pickup_datetime")}, dq_errors, dq_error_count, dq_valid FROM silver
""", "silver"))
def dq_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_trips(spark, sf_dir).select(
        *_TRIP_KEY,
        stamp("pickup_datetime"),
        F.array_join("dq_errors", ",").alias("dq_errors"),
        "dq_error_count",
        "dq_valid",
    )


_ROW = f"{_TRIP_KEY_SQL}, {stamp_sql('pickup_datetime')}, {stamp_sql('dropoff_datetime')}, trip_distance, total_amount, trip_duration_minutes"


def _trip_rows(df: DataFrame) -> DataFrame:
    return df.select(
        *_TRIP_KEY,
        stamp("pickup_datetime"),
        stamp("dropoff_datetime"),
        "trip_distance",
        "total_amount",
        "trip_duration_minutes",
    )


@query("valid_trips", sql(f"SELECT {_ROW} FROM silver WHERE dq_valid", "silver"))
def valid_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trip_rows(valid_only(silver_trips(spark, sf_dir)))


@query("quarantine_rows", sql(f"SELECT {_ROW} FROM silver WHERE NOT dq_valid", "silver"))
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trip_rows(invalid_only(silver_trips(spark, sf_dir)))


@query("silver_contract", sql("""
SELECT service, count(*) AS trips, CAST(0 AS BIGINT) AS with_mta_tax,
  count(fare_amount) AS with_fare, count(passenger_count) AS with_passengers
FROM silver GROUP BY ALL
""", "silver"))
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Silver table written before an optional column existed still meets the contract."""
    older = silver_trips(spark, sf_dir).drop("mta_tax", "bcf", "airport_fee")
    return (
        silver_contract(older)
        .groupBy("service")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.count("mta_tax").alias("with_mta_tax"),
            F.count("fare_amount").alias("with_fare"),
            F.count("passenger_count").alias("with_passengers"),
        )
    )


@query("silver_month_scope", sql("""
SELECT service, pickup_borough, count(*) AS trips, sum(coalesce(total_amount, 0)) AS revenue
FROM enriched WHERE year = 2023 AND month = 3 GROUP BY ALL
""", "enriched"))
def silver_month_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of Silver, chosen by a filter on the partition columns."""
    scoped = silver_trips(spark, sf_dir).where((F.col("year") == 2023) & (F.col("month") == 3))
    return (
        enrich_trips(valid_only(scoped), zone_lookup(spark, sf_dir))
        .groupBy("service", "pickup_borough")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.sum(F.coalesce("total_amount", F.lit(0.0))).alias("revenue"),
        )
    )


@query("zone_lookup", sql("SELECT * FROM zones", "zones"))
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_lookup(spark, sf_dir)


@query("calendar_fields", """
SELECT event_id, CAST(ts AS DATE) AS pickup_date, CAST(year(ts) AS INTEGER) AS pickup_year,
  CAST(month(ts) AS INTEGER) AS pickup_month, CAST(dayofweek(ts) + 1 AS INTEGER) AS pickup_day_of_week,
  CAST(hour(ts) AS INTEGER) AS pickup_hour FROM events
""")
def calendar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = calendar_columns("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", *(column.alias(name) for name, column in fields.items())
    )


@query("slot_flags", """
SELECT event_id, hour(ts) BETWEEN 0 AND 5 AS night, hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 19 AS rush,
  dayofweek(ts) IN (0, 6) AS weekend FROM events
""")
def slot_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        is_night(hour).alias("night"),
        is_rush(hour).alias("rush"),
        is_weekend(F.dayofweek("ts")).alias("weekend"),
    )


@query("enrich_zones", sql(f"""
SELECT {_TRIP_KEY_SQL}, {stamp_sql("pickup_datetime")}, pickup_borough, pickup_zone, pickup_service_zone,
  dropoff_borough, dropoff_zone, dropoff_service_zone
FROM enriched
""", "enriched"))
def enrich_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_trips(spark, sf_dir).select(
        *_TRIP_KEY,
        stamp("pickup_datetime"),
        *(f"{role}_{n}" for role in ("pickup", "dropoff") for n in ("borough", "zone", "service_zone")),
    )


@query("dq_counts", sql("""
SELECT service, year, month, count(*) AS rows, count(*) FILTER (WHERE dq_valid) AS valid_rows,
  count(*) FILTER (WHERE NOT dq_valid) AS invalid_rows
FROM silver GROUP BY ALL
""", "silver"))
def dq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_counts(silver_trips(spark, sf_dir))


@query("dq_rule_counts", sql("""
SELECT service, year, month, rule, count(*) AS failures
FROM (SELECT service, year, month, unnest(string_split(dq_errors, ',')) AS rule FROM silver WHERE dq_errors <> '')
GROUP BY ALL
""", "silver"))
def dq_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_failures(silver_trips(spark, sf_dir))


@query("reconciliation", sql("""
SELECT service, year, month, count(*) AS source_rows, count(*) AS silver_rows,
  count(*) FILTER (WHERE dq_valid) AS valid_rows, count(*) FILTER (WHERE NOT dq_valid) AS quarantine_rows,
  true AS reconciled
FROM silver GROUP BY ALL
""", "silver"))
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, Silver and quarantine counted apart and joined per file."""
    source = trip_facts(spark, sf_dir).select(
        F.col("family").alias("service"),
        F.col("file_year").alias("year"),
        F.col("file_month").alias("month"),
    )
    silver = silver_trips(spark, sf_dir)
    return reconcile_counts(source, silver, invalid_only(silver))


@query("reconciliation_total", sql("""
SELECT count(DISTINCT (service, year, month)) AS files_processed, count(*) AS source_rows, count(*) AS silver_rows,
  count(*) FILTER (WHERE dq_valid) AS valid_rows, count(*) FILTER (WHERE NOT dq_valid) AS quarantine_rows,
  true AS reconciled
FROM silver
""", "silver"))
def reconciliation_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_total(reconciliation(spark, sf_dir))


_EVENT_DATES = """
SELECT event_id, CAST(ts AS DATE) AS d FROM events
"""


@query("date_functions", f"""
SELECT event_id, d AS day, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, CAST(day(d) AS INTEGER) AS dom,
  CAST(dayofyear(d) AS INTEGER) AS doy, CAST(weekofyear(d) AS INTEGER) AS woy, CAST(d - DATE '2023-01-01' AS INTEGER) AS since,
  d + 1 AS next_day, d - 90 AS cutoff, strftime(d, '%Y-%m-%d') AS day_text
FROM ({_EVENT_DATES})
""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        day.alias("day"),
        F.year(day).alias("y"),
        F.month(day).alias("m"),
        F.dayofmonth(day).alias("dom"),
        F.dayofyear(day).alias("doy"),
        F.weekofyear(day).alias("woy"),
        F.datediff(day, F.lit("2023-01-01").cast("date")).alias("since"),
        F.date_add(day, 1).alias("next_day"),
        F.date_sub(day, 90).alias("cutoff"),
        F.date_format(day, "yyyy-MM-dd").alias("day_text"),
    )


@query("route_label", sql("""
SELECT pickup_zone || ' → ' || dropoff_zone AS route, count(*) AS trips FROM enriched GROUP BY ALL
""", "enriched"))
def route_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = route_label(F.col("pickup_zone"), F.col("dropoff_zone"))
    return (
        enriched_trips(spark, sf_dir)
        .groupBy(label.alias("route"))
        .agg(F.count(F.lit(1)).alias("trips"))
    )


@query("normalise_text", r"""
SELECT page_id, lower(trim(regexp_replace(strip_accents(title), '\s+', ' ', 'g'))) AS title
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
""")
def normalised_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", normalise_text(title).alias("title"))


@query("file_id", "SELECT page_id, sha256(url) AS file_id FROM pages")
def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", file_id(F.col("url"), F.lit("")).alias("file_id")
    )
