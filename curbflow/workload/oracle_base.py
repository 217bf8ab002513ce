"""Named SQL building blocks shared by the oracle queries.

Each block is ordinary DuckDB SQL over the driver tables. ``sql(body, "block", ...)`` prefixes a
query with the blocks it names and the blocks those need.
"""

from __future__ import annotations

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, *needs: str, body: str) -> None:
    BLOCKS[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for inner in BLOCKS[name][0]:
                add(inner)
            ordered.append(name)

    for name in needs:
        add(name)
    parts = ",\n".join(f"{name} AS (\n{BLOCKS[name][1].strip()}\n)" for name in ordered)
    return f"WITH {parts}\n{body.strip()}" if parts else body.strip()


block("trips", body="""
SELECT
  CASE l_orderkey % 4 WHEN 0 THEN 'yellow' WHEN 1 THEN 'green' WHEN 2 THEN 'fhv' ELSE 'fhvhv' END AS service,
  2023 AS year,
  CAST(month(day0) AS INTEGER) AS month,
  began AS pickup_datetime,
  began + to_minutes(CAST(m AS BIGINT)) AS dropoff_datetime,
  m, origin, destination, miles, fare, tip, tax, tolls, payment, riders, extra, congestion, vendor, base
FROM (
  SELECT *,
    CAST(day0 AS TIMESTAMP) + to_days(CASE WHEN l_partkey % 97 = 0 THEN 31 ELSE 0 END)
      + to_minutes(CAST((l_orderkey * 37 + l_linenumber * 11) % 1440 AS BIGINT)) AS began,
    CASE WHEN l_partkey % 83 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN -5
         WHEN l_partkey % 79 = 0 THEN 2000 ELSE CAST(l_quantity AS INTEGER) END AS m,
    CAST(CASE WHEN l_partkey % 101 = 0 THEN 999 ELSE s_nationkey + 1 END AS INTEGER) AS origin,
    CAST(CASE WHEN l_partkey % 103 = 0 THEN NULL ELSE c_nationkey + 1 END AS INTEGER) AS destination,
    CASE WHEN l_partkey % 107 = 0 THEN 600.0::DOUBLE ELSE l_quantity / 4 END AS miles,
    floor(l_extendedprice / 1000) AS fare,
    floor(floor(l_extendedprice / 1000) * l_discount * 4) / 4.0::DOUBLE AS tip,
    floor(floor(l_extendedprice / 1000) * l_tax * 4) / 4.0::DOUBLE AS tax,
    CASE WHEN l_partkey % 109 = 0 THEN 20000.0::DOUBLE ELSE 0.0::DOUBLE END AS tolls,
    CAST(l_linenumber % 6 + 1 AS INTEGER) AS payment,
    l_linenumber AS riders,
    (l_linenumber % 3) * 0.5::DOUBLE AS extra,
    CASE WHEN l_linenumber % 2 = 1 THEN 2.75::DOUBLE END AS congestion,
    CAST(l_suppkey % 2 + 1 AS INTEGER) AS vendor,
    'B' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS base
  FROM (
    SELECT *, DATE '2023-01-01' + CAST((CAST(o_orderdate AS DATE) - DATE '1995-01-01') % 180 AS INTEGER) AS day0
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey
  )
)
""")

block("canonical", "trips", body="""
SELECT
  service || '_tripdata_' || year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '.parquet' AS source_file,
  service, year, month, pickup_datetime, dropoff_datetime,
  CASE WHEN service = 'fhvhv' THEN pickup_datetime - to_minutes(5) END AS request_datetime,
  CASE WHEN service IN ('yellow', 'green') THEN vendor END AS vendor_id,
  CASE WHEN service = 'fhvhv' THEN base END AS hvfhs_license_num,
  CASE WHEN service = 'fhv' THEN base END AS dispatching_base_num,
  origin AS pickup_location_id, destination AS dropoff_location_id,
  CASE WHEN service IN ('yellow', 'green') THEN riders END AS passenger_count,
  CASE WHEN service <> 'fhv' THEN miles END AS trip_distance,
  CASE WHEN service = 'fhvhv' THEN CAST(m AS BIGINT) * 60 END AS reported_trip_time_seconds,
  payment AS payment_type,
  CASE WHEN service <> 'fhv' THEN fare END AS fare_amount,
  CASE WHEN service = 'fhvhv' THEN fare END AS base_passenger_fare,
  CASE WHEN service IN ('yellow', 'green') THEN extra END AS extra,
  CASE WHEN service <> 'fhv' THEN tip END AS tip_amount,
  CASE WHEN service <> 'fhv' THEN tolls END AS tolls_amount,
  CASE WHEN service IN ('yellow', 'green') THEN fare + tip + tolls
       WHEN service = 'fhvhv' THEN fare + tolls + tax + coalesce(congestion, 0) + tip END AS total_amount,
  CASE WHEN service = 'fhvhv' THEN congestion END AS congestion_surcharge,
  CASE WHEN service = 'fhvhv' THEN tax END AS sales_tax,
  date_diff('second', pickup_datetime, dropoff_datetime) / 60.0::DOUBLE AS trip_duration_minutes
FROM trips
""")

block("silver", "canonical", body="""
SELECT *,
  CAST(list_count(list_filter([e1, e2, e3, e4, e5, e6, e7, e8], lambda x: x IS NOT NULL)) AS INTEGER) AS dq_error_count,
  coalesce(array_to_string(list_filter([e1, e2, e3, e4, e5, e6, e7, e8], lambda x: x IS NOT NULL), ','), '') AS dq_errors,
  coalesce(e1, e2, e3, e4, e5, e6, e7, e8) IS NULL AS dq_valid
FROM (
  SELECT *,
    CASE WHEN pickup_datetime IS NULL THEN 'PICKUP_DATETIME' END AS e1,
    CASE WHEN dropoff_datetime IS NULL THEN 'DROPOFF_DATETIME' END AS e2,
    CASE WHEN year(pickup_datetime) = year AND month(pickup_datetime) = month THEN NULL
         ELSE 'PICKUP_OUTSIDE_FILE_PERIOD' END AS e3,
    CASE WHEN trip_duration_minutes > 0 AND trip_duration_minutes <= 1440 THEN NULL ELSE 'TRIP_DURATION' END AS e4,
    CASE WHEN pickup_location_id BETWEEN 1 AND 265 THEN NULL ELSE 'PICKUP_LOCATION' END AS e5,
    CASE WHEN dropoff_location_id BETWEEN 1 AND 265 THEN NULL ELSE 'DROPOFF_LOCATION' END AS e6,
    CASE WHEN service = 'fhv' OR trip_distance BETWEEN 0 AND 500 THEN NULL ELSE 'TRIP_DISTANCE' END AS e7,
    CASE WHEN service = 'fhv' OR abs(total_amount) <= 10000 THEN NULL ELSE 'TOTAL_AMOUNT' END AS e8
  FROM canonical
)
""")

block("zones", body="""
SELECT CAST(n_nationkey + 1 AS INTEGER) AS location_id, r_name AS borough, n_name AS zone, r_name AS service_zone
FROM nation JOIN region ON n_regionkey = r_regionkey
""")

block("enriched", "silver", "zones", body="""
SELECT s.*,
  coalesce(p.borough, 'Unknown') AS pickup_borough, coalesce(p.zone, 'Unknown') AS pickup_zone,
  coalesce(p.service_zone, 'Unknown') AS pickup_service_zone,
  coalesce(d.borough, 'Unknown') AS dropoff_borough, coalesce(d.zone, 'Unknown') AS dropoff_zone,
  coalesce(d.service_zone, 'Unknown') AS dropoff_service_zone,
  CAST(pickup_datetime AS DATE) AS pickup_date,
  CAST(year(pickup_datetime) AS INTEGER) AS pickup_year,
  CAST(month(pickup_datetime) AS INTEGER) AS pickup_month,
  CAST(dayofweek(pickup_datetime) + 1 AS INTEGER) AS pickup_day_of_week,
  CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour
FROM silver s
LEFT JOIN zones p ON s.pickup_location_id = p.location_id
LEFT JOIN zones d ON s.dropoff_location_id = d.location_id
WHERE dq_valid
""")

block("daily", "enriched", body="""
SELECT *,
  total_revenue / trip_count AS revenue_per_trip,
  CASE WHEN duration_minutes > 0 THEN distance_miles / (duration_minutes / 60.0::DOUBLE) END AS avg_speed_mph,
  CASE WHEN fare_revenue > 0 THEN tip_revenue / fare_revenue END AS tip_share
FROM (
  SELECT pickup_date, pickup_year, pickup_month, pickup_day_of_week, service,
    pickup_location_id, pickup_borough, pickup_zone, pickup_service_zone,
    count(*) AS trip_count,
    sum(coalesce(passenger_count, 0)::DOUBLE) AS passenger_total,
    sum(coalesce(total_amount, 0)) AS total_revenue,
    sum(coalesce(fare_amount, 0)) AS fare_revenue,
    sum(coalesce(tip_amount, 0)) AS tip_revenue,
    sum(coalesce(tolls_amount, 0)) AS tolls_revenue,
    sum(coalesce(trip_distance, 0)) AS distance_miles,
    sum(coalesce(trip_duration_minutes, 0)) AS duration_minutes,
    CAST(count(*) FILTER (WHERE pickup_hour BETWEEN 0 AND 5) AS BIGINT) AS night_trips,
    CAST(count(*) FILTER (WHERE pickup_hour BETWEEN 7 AND 9 OR pickup_hour BETWEEN 16 AND 19) AS BIGINT) AS rush_hour_trips,
    CAST(count(*) FILTER (WHERE pickup_day_of_week IN (1, 7)) AS BIGINT) AS weekend_trips,
    avg(trip_distance) AS avg_trip_distance,
    avg(trip_duration_minutes) AS avg_trip_duration_minutes,
    avg(total_amount) AS avg_total_amount
  FROM enriched GROUP BY ALL
)
""")

block("hourly", "enriched", body="""
SELECT pickup_date, pickup_year, pickup_month, pickup_day_of_week, pickup_hour, service,
  pickup_location_id, pickup_borough, pickup_zone, pickup_service_zone,
  count(*) AS trip_count,
  sum(coalesce(total_amount, 0)) AS total_revenue,
  sum(coalesce(tip_amount, 0)) AS tip_revenue,
  sum(coalesce(trip_distance, 0)) AS distance_miles,
  sum(coalesce(trip_duration_minutes, 0)) AS duration_minutes,
  avg(trip_distance) AS avg_trip_distance,
  avg(trip_duration_minutes) AS avg_trip_duration_minutes,
  avg(total_amount) AS avg_total_amount
FROM enriched GROUP BY ALL
""")

block("finance", "enriched", body="""
SELECT pickup_year, pickup_month, service, payment_type,
  count(*) AS trip_count,
  sum(coalesce(total_amount, 0)) AS total_revenue,
  sum(coalesce(fare_amount, 0)) AS fare_revenue,
  sum(coalesce(tip_amount, 0)) AS tip_revenue,
  sum(coalesce(tolls_amount, 0)) AS tolls_revenue,
  sum(coalesce(extra, 0) + coalesce(congestion_surcharge, 0) + coalesce(sales_tax, 0)) AS taxes_and_surcharges,
  count(*) FILTER (WHERE tip_amount > 0) AS tipped_trips,
  avg(total_amount) AS avg_total_amount,
  avg(tip_amount) AS avg_tip_amount
FROM enriched GROUP BY ALL
""")

block("routes", "enriched", body="""
SELECT pickup_year, pickup_month, service, pickup_location_id, pickup_borough, pickup_zone,
  dropoff_location_id, dropoff_borough, dropoff_zone,
  count(*) AS trip_count,
  sum(coalesce(total_amount, 0)) AS total_revenue,
  avg(trip_distance) AS avg_trip_distance,
  avg(trip_duration_minutes) AS avg_trip_duration_minutes,
  avg(CASE WHEN trip_duration_minutes > 0 THEN trip_distance / (trip_duration_minutes / 60.0::DOUBLE) END) AS avg_speed_mph,
  quantile_disc(trip_duration_minutes, 0.5) AS median_trip_duration_minutes,
  avg(CASE WHEN trip_distance > 0 THEN total_amount / trip_distance END) AS avg_fare_per_mile
FROM enriched GROUP BY ALL
""")

block("tips", "enriched", body="""
SELECT *,
  tipped_trips::DOUBLE / trip_count AS tipped_trip_share,
  CASE WHEN fare_revenue > 0 THEN tip_revenue / fare_revenue END AS aggregate_tip_rate
FROM (
  SELECT pickup_year, pickup_month, pickup_day_of_week, pickup_hour, service, payment_type, pickup_borough,
    count(*) AS trip_count,
    count(*) FILTER (WHERE tip_amount > 0) AS tipped_trips,
    sum(coalesce(fare_amount, 0)) AS fare_revenue,
    sum(coalesce(tip_amount, 0)) AS tip_revenue,
    avg(CASE WHEN fare_amount > 0 THEN tip_amount / fare_amount END) AS avg_trip_tip_rate,
    avg(trip_distance) AS avg_trip_distance,
    avg(trip_duration_minutes) AS avg_trip_duration_minutes
  FROM enriched GROUP BY ALL
)
""")

block("anomalies", "daily", body="""
SELECT *,
  greatest(abs(round(demand_zscore, 9)), abs(round(revenue_zscore, 9))) >= 3.0 AS is_anomaly,
  CASE WHEN round(demand_zscore, 9) >= 3.0 THEN 'HIGH' WHEN round(demand_zscore, 9) <= -3.0 THEN 'LOW' ELSE 'NORMAL' END AS anomaly_direction
FROM (
  SELECT *,
    CASE WHEN baseline_stddev_trips > 0 THEN (trip_count - baseline_avg_trips) / baseline_stddev_trips ELSE 0.0 END AS demand_zscore,
    CASE WHEN baseline_stddev_revenue > 0 THEN (total_revenue - baseline_avg_revenue) / baseline_stddev_revenue ELSE 0.0 END AS revenue_zscore
  FROM (
    SELECT *,
      avg(trip_count) OVER w AS baseline_avg_trips,
      stddev_pop(trip_count) OVER w AS baseline_stddev_trips,
      avg(total_revenue) OVER w AS baseline_avg_revenue,
      stddev_pop(total_revenue) OVER w AS baseline_stddev_revenue
    FROM daily
    WINDOW w AS (PARTITION BY service, pickup_location_id, pickup_day_of_week)
  )
)
""")

block("service_day", "daily", body="""
SELECT pickup_date AS trip_date, service AS service_type, sum(trip_count)::DOUBLE AS trip_count
FROM daily GROUP BY ALL
""")

block("panel", "service_day", body="""
SELECT c.service_type, c.trip_date, coalesce(s.trip_count, 0.0::DOUBLE) AS trip_count
FROM (
  SELECT service_type, CAST(unnest(generate_series(min(trip_date), max(trip_date), INTERVAL 1 DAY)) AS DATE) AS trip_date
  FROM service_day GROUP BY service_type
) c
LEFT JOIN service_day s USING (service_type, trip_date)
""")

block("zone_date", "daily", body="""
SELECT pickup_date AS trip_date, CAST(pickup_location_id AS VARCHAR) AS zone_id,
  sum(trip_count)::DOUBLE AS trip_count, max(pickup_zone) AS zone_name
FROM daily GROUP BY ALL
""")

block("zone_panel", "zone_date", body="""
SELECT c.zone_id, c.trip_date, coalesce(s.trip_count, 0.0::DOUBLE) AS trip_count
FROM (
  SELECT zone_id, CAST(unnest(generate_series(min(trip_date), max(trip_date), INTERVAL 1 DAY)) AS DATE) AS trip_date
  FROM zone_date GROUP BY zone_id
) c
LEFT JOIN zone_date s USING (zone_id, trip_date)
""")


def feature_sql(panel: str, entity: str) -> str:
    return f"""
SELECT {entity}, trip_date, trip_count,
  dayofweek(trip_date)::DOUBLE AS day_of_week, month(trip_date)::DOUBLE AS month,
  day(trip_date)::DOUBLE AS day_of_month, dayofyear(trip_date)::DOUBLE AS day_of_year,
  weekofyear(trip_date)::DOUBLE AS week_of_year,
  CASE WHEN dayofweek(trip_date) IN (0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
  sin(2 * pi() * dayofyear(trip_date) / 365.25::DOUBLE) AS sin_day_of_year,
  cos(2 * pi() * dayofyear(trip_date) / 365.25::DOUBLE) AS cos_day_of_year,
  (trip_date - min(trip_date) OVER (PARTITION BY {entity}))::DOUBLE AS trend_days,
  lag(trip_count, 1) OVER w AS lag_1, lag(trip_count, 7) OVER w AS lag_7,
  lag(trip_count, 14) OVER w AS lag_14, lag(trip_count, 28) OVER w AS lag_28,
  avg(trip_count) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
  avg(trip_count) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS rolling_mean_28
FROM {panel}
WINDOW w AS (PARTITION BY {entity} ORDER BY trip_date)
"""


block("features", "panel", body=feature_sql("panel", "service_type"))
block("zone_time", "zone_panel", body=feature_sql("zone_panel", "zone_id"))

block("zone_split", "zone_time", body="""
SELECT *, CASE WHEN trip_date > cutoff_date THEN 'test' ELSE 'train' END AS split
FROM (
  SELECT *, max(trip_date) OVER (PARTITION BY zone_id) - 21 AS cutoff_date
  FROM zone_time WHERE lag_28 IS NOT NULL
)
""")

block("model_split", "zone_time", body="""
SELECT *, CASE WHEN trip_date > cutoff_date THEN 'test' ELSE 'train' END AS split
FROM (
  SELECT *, max(trip_date) OVER (PARTITION BY zone_id) - 90 AS cutoff_date
  FROM zone_time WHERE lag_28 IS NOT NULL
)
""")

block("zone_days", "daily", body="""
SELECT CAST(pickup_location_id AS VARCHAR) AS zone_id, pickup_date AS date,
  sum(trip_count)::DOUBLE AS trips, max(pickup_zone) AS zone_name, max(pickup_borough) AS borough,
  coalesce(sum(avg_total_amount * trip_count) / sum(CASE WHEN avg_total_amount IS NOT NULL THEN trip_count END), 0) AS fare,
  coalesce(sum(avg_trip_distance * trip_count) / sum(CASE WHEN avg_trip_distance IS NOT NULL THEN trip_count END), 0) AS distance,
  coalesce(sum(avg_trip_duration_minutes * trip_count) / sum(CASE WHEN avg_trip_duration_minutes IS NOT NULL THEN trip_count END), 0) AS duration,
  sum(total_revenue) AS revenue
FROM daily GROUP BY ALL
""")

block("zone_vectors", "zone_days", body="""
SELECT zone_id, sum(trips) AS total_trips, avg(trips) AS avg_daily_trips, stddev_pop(trips) AS demand_stddev,
  count(DISTINCT date)::DOUBLE AS active_days,
  sum(fare * trips) / sum(trips) AS avg_fare_amount,
  sum(distance * trips) / sum(trips) AS avg_trip_distance,
  sum(duration * trips) / sum(trips) AS avg_duration_minutes,
  sum(revenue) AS total_revenue, max(zone_name) AS zone_name, max(borough) AS borough
FROM zone_days GROUP BY zone_id
""")

block("audit", body="""
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
  CASE user_id % 3 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'OK' ELSE 'FAILED' END AS status,
  ts AS timestamp_utc, CAST(user_id AS VARCHAR) AS run_id, props AS details
FROM events
""")

block("dim_days", body="""
SELECT d AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month_number,
  ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(d)] AS month_name,
  'T' || quarter(d) AS quarter, strftime(d, '%Y-%m') AS year_month,
  CAST(year(d) * 100 + month(d) AS INTEGER) AS year_month_order,
  CAST(isodow(d) AS INTEGER) AS weekday_number,
  ['lunes','martes','miércoles','jueves','viernes','sábado','domingo'][isodow(d)] AS weekday_name,
  isodow(d) >= 6 AS is_weekend
FROM (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2026-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
""")

block("dim_services", body="""
SELECT * FROM (VALUES ('yellow', 'Yellow Taxi'), ('green', 'Green Taxi'),
  ('fhv', 'For-Hire Vehicle'), ('fhvhv', 'High Volume FHV')) t(service, service_name)
""")

block("dim_payments", body="""
SELECT * FROM (VALUES (1, 'Tarjeta'), (2, 'Efectivo'), (3, 'Sin cargo'), (4, 'Disputa'),
  (5, 'Desconocido'), (6, 'Viaje anulado')) t(payment_type, payment_name)
""")

block("dim_hours", body="""
SELECT CAST(h AS INTEGER) AS hour,
  CASE WHEN h < 6 THEN 'Madrugada' WHEN h < 12 THEN 'Mañana' WHEN h < 18 THEN 'Tarde' ELSE 'Noche' END AS hour_band,
  h BETWEEN 7 AND 9 OR h BETWEEN 16 AND 19 AS is_rush_hour
FROM (SELECT unnest(range(24)) AS h)
""")
