"""Marts, diagnostics and series queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import marts, series
from curbflow.operators.diagnostics import daily_anomalies, demand_labels
from curbflow.operators.zone_features import ZONE_FEATURES, zone_day, zone_features
from curbflow.workload.oracle_base import sql
from curbflow.workload.registry import query, tidied, tidy, tidy_sql
from curbflow.workload.trips import enriched_trips, mart

TEST_DAYS = 21


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart(spark, sf_dir, "daily")


@query("daily_demand", sql("SELECT * FROM daily", "daily"))
def daily_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.daily_demand(enriched_trips(spark, sf_dir))


@query("hourly_profile", sql("SELECT * FROM hourly", "hourly"))
def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.hourly_profile(enriched_trips(spark, sf_dir))


@query("service_financials", sql("SELECT * FROM finance", "finance"))
def service_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.service_financials(enriched_trips(spark, sf_dir))


_ROUTE_R = ("avg_trip_duration_minutes", "avg_speed_mph", "avg_fare_per_mile")


@query("route_performance", sql(
    f"SELECT * REPLACE ({tidy_sql(*_ROUTE_R)}) FROM routes", "routes"))
def route_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(marts.route_performance(enriched_trips(spark, sf_dir)), *_ROUTE_R)


_LEVELS = {
    "month": ("pickup_year", "pickup_month", "service"),
    "zone": ("pickup_location_id",),
    "boroughs": ("pickup_borough", "dropoff_borough"),
}
_ROLLED_R = ("avg_trip_distance", *_ROUTE_R)
_LOW, _HIGH = 0.5 - marts.SKETCH_RANK_ERROR, 0.5 + marts.SKETCH_RANK_ERROR


def _level_key(grain: tuple[str, ...], function: str) -> str:
    return f"{function}('/', {', '.join(f'CAST({n} AS {{}})' for n in grain)})"


_ROLLED = " UNION ALL ".join(f"""
SELECT '{level}' AS level, {_level_key(grain, "concat_ws").format(*["VARCHAR"] * len(grain))} AS key,
  count(*) AS trip_count, coalesce(sum(total_amount), 0) AS total_revenue, avg(trip_distance) AS avg_trip_distance,
  avg(trip_duration_minutes) AS avg_trip_duration_minutes,
  avg(CASE WHEN trip_duration_minutes > 0 THEN trip_distance / (trip_duration_minutes / 60) END) AS avg_speed_mph,
  avg(CASE WHEN trip_distance > 0 THEN total_amount / trip_distance END) AS avg_fare_per_mile,
  quantile_disc(trip_duration_minutes, {_LOW}) AS median_at_least, quantile_disc(trip_duration_minutes, {_HIGH}) AS median_at_most,
  CASE WHEN count(trip_duration_minutes) > 0 THEN true END AS median_within
FROM enriched GROUP BY {", ".join(grain)}""" for level, grain in _LEVELS.items())


@query("route_medians", sql(f"SELECT * REPLACE ({tidy_sql(*_ROLLED_R)}) FROM ({_ROLLED})", "enriched"))
def route_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, zones and pairs of boroughs from the routes' components and merged sketches. Trips are
    read only for the exact quantiles that each merged median must lie between."""
    base, trips = mart(spark, sf_dir, "route_base"), enriched_trips(spark, sf_dir).withColumns(
        {"pickup_year": F.year("pickup_datetime"), "pickup_month": F.month("pickup_datetime")}
    )
    parts = []
    for level, grain in _LEVELS.items():
        key = F.expr(_level_key(grain, "concat_ws").format(*["string"] * len(grain)))
        exact = trips.groupBy(key.alias("key")).agg(*(
            F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY trip_duration_minutes)").alias(n)
            for n, p in (("median_at_least", _LOW), ("median_at_most", _HIGH))
        ))
        rolled = marts.route_rollup(base, *grain).withColumns({"key": key, "level": F.lit(level)})
        parts.append(rolled.drop(*grain).join(exact, "key", "left"))
    rows = reduce(DataFrame.unionByName, parts).withColumn(
        "median_within", F.expr("median_trip_duration_minutes BETWEEN median_at_least AND median_at_most")
    )
    return tidied(rows.drop("median_trip_duration_minutes"), *_ROLLED_R)


@query("tip_factors", sql(
    f"SELECT * REPLACE ({tidy_sql("avg_trip_tip_rate", digits=9)}) FROM tips", "tips"))
def tip_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(marts.tip_factors(enriched_trips(spark, sf_dir)), "avg_trip_tip_rate", digits=9)


@query("rollup_daily", sql("SELECT * FROM daily", "daily"))
def rollup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mart again, this time summed from the hourly base instead of from trips."""
    return marts.DAILY_DEMAND.build(marts.trip_base(enriched_trips(spark, sf_dir)), from_base=True)


@query("rollup_finance", sql("SELECT * FROM finance", "finance"))
def rollup_finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = marts.trip_base(enriched_trips(spark, sf_dir))
    return marts.SERVICE_FINANCIALS.build(base, from_base=True)


@query("timeseries_base", sql("""
SELECT pickup_date, pickup_year, pickup_month, service, CAST(sum(trip_count) AS BIGINT) AS trip_count,
  sum(total_revenue) AS total_revenue, sum(distance_miles) AS distance_miles, sum(duration_minutes) AS duration_minutes,
  pickup_date AS ds, sum(trip_count)::DOUBLE AS y, CAST(dayofweek(pickup_date) IN (0, 6) AS INTEGER) AS is_weekend
FROM daily GROUP BY pickup_date, pickup_year, pickup_month, service
""", "daily"))
def timeseries_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.timeseries_base(daily(spark, sf_dir))


@query("zone_profile", sql("""
SELECT * REPLACE (round(stddev_daily_trips, 6) AS stddev_daily_trips),
  total_revenue / total_trips AS revenue_per_trip, total_distance_miles / total_trips AS avg_trip_distance,
  total_duration_minutes / total_trips AS avg_trip_duration_minutes, weekend_trips / total_trips::DOUBLE AS weekend_share,
  night_trips / total_trips::DOUBLE AS night_share, rush_hour_trips / total_trips::DOUBLE AS rush_hour_share
FROM (
  SELECT service, pickup_location_id, pickup_borough, pickup_zone, pickup_service_zone,
    CAST(sum(trip_count) AS BIGINT) AS total_trips, count(DISTINCT pickup_date) AS active_days,
    avg(trip_count) AS avg_daily_trips, stddev_pop(trip_count) AS stddev_daily_trips,
    sum(total_revenue) AS total_revenue, sum(distance_miles) AS total_distance_miles,
    sum(duration_minutes) AS total_duration_minutes, CAST(sum(weekend_trips) AS BIGINT) AS weekend_trips,
    CAST(sum(night_trips) AS BIGINT) AS night_trips, CAST(sum(rush_hour_trips) AS BIGINT) AS rush_hour_trips
  FROM daily GROUP BY ALL
)
""", "daily"))
def zone_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(marts.zone_profile(daily(spark, sf_dir)), "stddev_daily_trips")


_ANOMALY_R = (
    "baseline_avg_trips",
    "baseline_stddev_trips",
    "baseline_avg_revenue",
    "baseline_stddev_revenue",
    "demand_zscore",
    "revenue_zscore",
)


@query("daily_anomalies", sql(
    f"SELECT * REPLACE ({tidy_sql(*_ANOMALY_R)}) FROM anomalies", "anomalies"))
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(daily_anomalies(daily(spark, sf_dir)), *_ANOMALY_R)


@query("demand_labels", sql("""
SELECT *, CAST(trip_count >= demand_threshold AS INTEGER) AS label_high_demand,
  CAST(trip_count >= demand_threshold AS INTEGER)::DOUBLE AS label
FROM (
  SELECT *,
    quantile_disc(trip_count, 0.75) OVER (PARTITION BY service, pickup_location_id)::DOUBLE AS demand_threshold,
    lag(trip_count) OVER (PARTITION BY service, pickup_location_id ORDER BY pickup_date, pickup_hour)::DOUBLE AS previous_observed_trip_count,
    CAST(pickup_day_of_week IN (1, 7) AS INTEGER) AS is_weekend,
    CAST(pickup_hour BETWEEN 7 AND 9 OR pickup_hour BETWEEN 16 AND 19 AS INTEGER) AS is_rush_hour
  FROM hourly
)
""", "hourly"))
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_labels(mart(spark, sf_dir, "hourly"))


@query("daily_service", sql("SELECT * FROM service_day", "service_day"))
def daily_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_service(daily(spark, sf_dir))


@query("zone_daily", sql("SELECT * FROM zone_date", "zone_date"))
def zone_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.zone_daily(daily(spark, sf_dir))


_ZONE_DAY_R = ("fare", "distance", "duration")


@query("zone_day", sql(f"SELECT * REPLACE ({tidy_sql(*_ZONE_DAY_R)}) FROM zone_days", "zone_days"))
def zone_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(zone_day(daily(spark, sf_dir)), *_ZONE_DAY_R)


@query("zone_features", sql(
    f"SELECT * REPLACE ({tidy_sql(*ZONE_FEATURES)}) FROM zone_vectors", "zone_vectors"))
def features_of_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(zone_features(daily(spark, sf_dir)), *ZONE_FEATURES)


@query("distinct_vectors", sql(
    f"SELECT count(*) AS zones, count(DISTINCT ({', '.join(f'round({n}, 6)' for n in ZONE_FEATURES)})) AS vectors FROM zone_vectors",
    "zone_vectors"))
def distinct_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct feature vectors, the check a clustering needs before it starts."""
    rounded = zone_features(daily(spark, sf_dir)).select(
        *(tidy(F.col(n)).alias(n) for n in ZONE_FEATURES)
    )
    return rounded.groupBy(*ZONE_FEATURES).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("zones"), F.count(F.lit(1)).alias("vectors")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.complete_panel(
        series.daily_service(daily(spark, sf_dir)), entity="service_type"
    )


def zone_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.complete_panel(series.zone_daily(daily(spark, sf_dir)), entity="zone_id")


@query("daily_panel", sql("SELECT * FROM panel", "panel"))
def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir)


_WAVES = ("sin_day_of_year", "cos_day_of_year")


@query("time_features", sql(
    f"SELECT * REPLACE ({tidy_sql(*_WAVES, 'rolling_mean_7', 'rolling_mean_28')}) FROM features", "features"))
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = series.time_features(panel(spark, sf_dir), entity="service_type")
    return tidied(frame, *_WAVES, "rolling_mean_7", "rolling_mean_28")


@query("seasonal_encoding", f"""
SELECT event_id, {tidy_sql(*_WAVES, digits=9)}
FROM (SELECT event_id, sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS sin_day_of_year,
        cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS cos_day_of_year FROM events)
""")
def seasonal_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    waves = series.calendar_features(F.to_date("ts"))
    return events.select("event_id", *(tidy(waves[n], 9).alias(n) for n in _WAVES))


def zone_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = series.time_features(zone_panel(spark, sf_dir), entity="zone_id")
    complete = frame.dropna(subset=list(series.TIME_FEATURES))
    return series.tag_split(complete, entity="zone_id", test_days=TEST_DAYS)


@query("temporal_split", sql(
    "SELECT zone_id, trip_date, trip_count, cutoff_date, split FROM zone_split", "zone_split"))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_split(spark, sf_dir).select(
        "zone_id", "trip_date", "trip_count", "cutoff_date", "split"
    )


@query("demand_threshold", sql("""
SELECT quantile_disc(trip_count, 0.75)::DOUBLE AS threshold FROM zone_split WHERE split = 'train' AND trip_count > 0
""", "zone_split"))
def demand_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = zone_split(spark, sf_dir).where(F.col("split") == "train")
    return series.demand_threshold(train, 0.75)


@query("class_weights", sql("""
SELECT label, n AS rows, total / (2.0::DOUBLE * n) AS class_weight
FROM (
  SELECT CAST(trip_count >= t AS INTEGER) AS label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
  FROM zone_split, (SELECT quantile_disc(trip_count, 0.75) AS t FROM zone_split WHERE split = 'train' AND trip_count > 0)
  WHERE split = 'train' GROUP BY 1
)
""", "zone_split"))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = zone_split(spark, sf_dir).where(F.col("split") == "train")
    threshold = series.demand_threshold(train, 0.75).scalar()
    labelled = train.withColumn("label", (F.col("trip_count") >= threshold).cast("double"))
    return series.class_weights(labelled)


_ERRORS = ("rmse", "mae", "r2", "mape_percent", "wmape_percent")


@query("forecast_metrics", sql(f"""
SELECT rows, {tidy_sql(*_ERRORS)}
FROM (
  SELECT count(*) AS rows, sqrt(avg((lag_7 - trip_count) ** 2)) AS rmse, avg(abs(lag_7 - trip_count)) AS mae,
    1 - sum((lag_7 - trip_count) ** 2) / (var_pop(trip_count) * count(*)) AS r2,
    100 * avg(CASE WHEN trip_count > 0 THEN abs(lag_7 - trip_count) / trip_count END) AS mape_percent,
    100 * sum(abs(lag_7 - trip_count)) / sum(abs(trip_count)) AS wmape_percent
  FROM features WHERE lag_28 IS NOT NULL
)
""", "features"))
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five errors of the naive same-weekday-last-week forecast."""
    frame = series.time_features(panel(spark, sf_dir), entity="service_type")
    complete = frame.dropna(subset=list(series.TIME_FEATURES))
    return tidied(series.forecast_errors(complete, predicted="lag_7"), *_ERRORS)


@query("trip_share", sql("""
SELECT zone_id, total_trips, total_trips / sum(total_trips) OVER () AS trip_share FROM zone_vectors
""", "zone_vectors"))
def trip_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the network total; the total is a scalar subquery, not a one-task window."""
    zones = (
        series.zone_daily(daily(spark, sf_dir))
        .groupBy("zone_id")
        .agg(F.sum("trip_count").alias("total_trips"))
    )
    network = zones.agg(F.sum("total_trips")).scalar()
    return zones.withColumn("trip_share", F.col("total_trips") / network)
