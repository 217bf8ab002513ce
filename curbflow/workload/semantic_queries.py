"""Dimensions, star joins, measures, pages and contracts over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators.diagnostics import daily_anomalies
from curbflow.plans import dimensions as dims
from curbflow.plans.contracts import build_contract
from curbflow.plans.measures import measure_by
from curbflow.plans.pages import PAGES, page_query
from curbflow.plans.star import FACTS, ROLES, attribute, star_join
from curbflow.workload.oracle_base import sql
from curbflow.workload.registry import query, tidied, tidy_sql
from curbflow.workload.trips import enriched_trips, mart, zone_lookup


def fact_rows(spark: SparkSession, sf_dir: str, fact: str) -> DataFrame:
    if fact == "anomalies":
        return daily_anomalies(mart(spark, sf_dir, "daily"))
    return mart(spark, sf_dir, {"demand": "daily"}.get(fact, fact))


def dimension_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "date": dims.date_dimension(spark),
        "service": dims.service_dimension(spark),
        "payment": dims.payment_dimension(spark),
        "hour": dims.hour_dimension(spark),
        "zone": zone_lookup(spark, sf_dir),
    }


def star(spark: SparkSession, sf_dir: str, fact: str) -> DataFrame:
    frames = dimension_frames(spark, sf_dir)
    return star_join(fact_rows(spark, sf_dir, fact), FACTS[fact], frames)


# --- dimensions: every member with the trips that fall on it -------------------------------

_DIMENSION_SQL = {
    "date": ("dim_days", "date", "pickup_date", "daily"),
    "service": ("dim_services", "service", "service", "daily"),
    "payment": ("dim_payments", "payment_type", "payment_type", "finance"),
    "hour": ("dim_hours", "hour", "pickup_hour", "hourly"),
}


def _register_dimension(name: str) -> None:
    block, key, link, source = _DIMENSION_SQL[name]
    oracle = sql(
        f"""
SELECT d.*, CAST(coalesce(f.trips, 0) AS BIGINT) AS trips
FROM {block} d LEFT JOIN (SELECT {link} AS k, sum(trip_count) AS trips FROM {source} GROUP BY 1) f ON d.{key} = f.k
""",
        block,
        source,
    )

    @query(f"dim_{name}", oracle)
    def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
        members = dimension_frames(spark, sf_dir)[name]
        usage = (
            mart(spark, sf_dir, source)
            .groupBy(F.col(link).alias("_link"))
            .agg(F.sum("trip_count").alias("trips"))
        )
        return (
            members.join(usage, members[key] == usage["_link"], "left")
            .drop("_link")
            .withColumn("trips", F.coalesce("trips", F.lit(0)))
        )


for _name in _DIMENSION_SQL:
    _register_dimension(_name)


def _register_zone(name: str, role: str) -> None:
    oracle = sql(
        f"""
SELECT z.*, count(e.service) AS trips
FROM zones z LEFT JOIN enriched e ON z.location_id = e.{role}_location_id GROUP BY ALL
""",
        "zones",
        "enriched",
    )

    @query(f"dim_{name}", oracle)
    def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
        zones = zone_lookup(spark, sf_dir)
        usage = (
            enriched_trips(spark, sf_dir)
            .groupBy(F.col(f"{role}_location_id").alias("_link"))
            .agg(F.count(F.lit(1)).alias("trips"))
        )
        return (
            zones.join(usage, zones["location_id"] == usage["_link"], "left")
            .drop("_link")
            .withColumn("trips", F.coalesce("trips", F.lit(0)))
        )


_register_zone("pickup_zone", "pickup")
_register_zone("dropoff_zone", "dropoff")


# --- star joins -----------------------------------------------------------------------------

_FACT_BLOCK = {
    "demand": "daily",
    "hourly": "hourly",
    "finance": "finance",
    "routes": "routes",
    "tips": "tips",
    "anomalies": "anomalies",
}
_DIM_BLOCK = {
    "date": "dim_days",
    "service": "dim_services",
    "zone": "zones",
    "payment": "dim_payments",
    "hour": "dim_hours",
}
_MONTHLY = "make_date(pickup_year, pickup_month, 1)"


def _register_star(fact: str) -> None:
    spec = FACTS[fact]
    block = _FACT_BLOCK[fact]
    joins, attributes, blocks = [], [], [block]
    for role, link in spec.links.items():
        dimension, key, names = ROLES[role]
        blocks.append(_DIM_BLOCK[dimension])
        joins.append(f"LEFT JOIN {_DIM_BLOCK[dimension]} {role}_d ON f.{link} = {role}_d.{key}")
        attributes += [f"{role}_d.{n} AS {attribute(role, n)}" for n in names]
    source = f"(SELECT *, {_MONTHLY} AS month_start FROM {block})" if spec.monthly else block
    links = list(spec.links.values())
    value = "is_anomaly" if fact == "anomalies" else "trip_count"
    oracle = sql(
        f"SELECT {', '.join('f.' + c for c in links)}, f.{value}, {', '.join(attributes)} "
        f"FROM {source} f {' '.join(joins)}",
        *blocks,
    )

    @query(f"star_{fact}", oracle)
    def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [attribute(role, n) for role in spec.links for n in ROLES[role][2]]
        return star(spark, sf_dir, fact).select(*links, value, *names)


for _fact in _FACT_BLOCK:
    _register_star(_fact)


# --- measures -------------------------------------------------------------------------------


def _measures(name: str, fact: str, keys: tuple[str, ...], body: str, *rounded: str) -> None:
    selected = f"SELECT * REPLACE ({tidy_sql(*rounded)}) FROM ({body})" if rounded else body

    @query(f"measures_{name}", sql(selected, _FACT_BLOCK[fact]))
    def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(measure_by(fact_rows(spark, sf_dir, fact), fact, keys), *rounded)


_measures("demand", "demand", ("service", "pickup_month"), """
SELECT service, pickup_month, CAST(sum(trip_count) AS BIGINT) AS trips, sum(total_revenue) AS revenue,
  sum(total_revenue) / nullif(sum(trip_count), 0) AS revenue_per_trip,
  sum(distance_miles) / nullif(sum(trip_count), 0) AS avg_distance
FROM daily GROUP BY ALL
""")
_measures("hourly", "hourly", ("service", "pickup_hour"), """
SELECT service, pickup_hour, CAST(sum(trip_count) AS BIGINT) AS trips,
  sum(duration_minutes) / nullif(sum(trip_count), 0) AS weighted_duration, sum(total_revenue) AS revenue
FROM hourly GROUP BY ALL
""")
_measures("finance", "finance", ("service", "payment_type"), """
SELECT service, payment_type, sum(total_revenue) AS revenue, sum(tip_revenue) AS tips,
  sum(tip_revenue) / nullif(sum(fare_revenue), 0) AS tip_rate,
  sum(tipped_trips) / nullif(sum(trip_count), 0)::DOUBLE AS tipped_share
FROM finance GROUP BY ALL
""")
_measures("anomaly", "anomalies", ("service", "pickup_borough"), """
SELECT service, pickup_borough, count(*) FILTER (WHERE is_anomaly) AS anomalies,
  count(*) FILTER (WHERE is_anomaly) / count(*)::DOUBLE AS anomaly_share, max(abs(demand_zscore)) AS max_abs_zscore
FROM anomalies GROUP BY ALL
""", "max_abs_zscore")
_measures("route", "routes", ("service", "pickup_borough", "dropoff_borough"), """
SELECT service, pickup_borough, dropoff_borough, CAST(sum(trip_count) AS BIGINT) AS trips,
  sum(avg_trip_duration_minutes * trip_count) / nullif(sum(trip_count), 0) AS weighted_duration,
  sum(avg_speed_mph * trip_count) / nullif(sum(trip_count), 0) AS weighted_speed
FROM routes GROUP BY ALL
""", "weighted_duration", "weighted_speed")
_measures("tip", "tips", ("service", "pickup_hour"), """
SELECT service, pickup_hour, sum(tip_revenue) / nullif(sum(fare_revenue), 0) AS tip_rate,
  sum(tipped_trips) / nullif(sum(trip_count), 0)::DOUBLE AS tipped_share, CAST(sum(trip_count) AS BIGINT) AS trips
FROM tips GROUP BY ALL
""")


# --- pages ----------------------------------------------------------------------------------

_KPI_SQL = {
    "page_01": ("sum(trip_count)", "sum(total_revenue)"),
    "page_02": ("sum(trip_count)", "sum(duration_minutes) / nullif(sum(trip_count), 0)"),
    "page_03": ("sum(total_revenue)", "sum(tip_revenue) / nullif(sum(fare_revenue), 0)"),
    "page_04": (
        "count(*) FILTER (WHERE is_anomaly)",
        "count(*) FILTER (WHERE is_anomaly) / count(*)::DOUBLE",
    ),
    "page_05": (
        "sum(trip_count)",
        "sum(avg_trip_duration_minutes * trip_count) / nullif(sum(trip_count), 0)",
    ),
    "page_06": (
        "sum(tip_revenue) / nullif(sum(fare_revenue), 0)",
        "sum(tipped_trips) / nullif(sum(trip_count), 0)::DOUBLE",
    ),
}


def page_sql(source: str, first: str, second: str, category: str, date: str, series: str) -> str:
    return f"""
SELECT CASE set_id WHEN 7 THEN 'total' WHEN 3 THEN 'by_category' WHEN 4 THEN 'trend' ELSE 'by_series' END AS block,
  category, date, series, {tidy_sql("first", "second")}
FROM (
  SELECT category, date, series, CAST({first} AS DOUBLE) AS first, CAST({second} AS DOUBLE) AS second,
    grouping_id(category, date, series) AS set_id
  FROM (SELECT *, CAST({category} AS VARCHAR) AS category, CAST({date} AS VARCHAR) AS date, CAST({series} AS VARCHAR) AS series FROM {source})
  GROUP BY GROUPING SETS ((), (category), (date, series), (series))
)
"""


def _register_page(name: str) -> None:
    page = PAGES[name]
    block = _FACT_BLOCK[page.fact]
    source = f"(SELECT *, {_MONTHLY} AS month_start FROM {block})"
    oracle = sql(
        page_sql(source, *_KPI_SQL[name], page.category, page.date, page.series), block
    )

    @query(name, oracle)
    def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(page_query(star(spark, sf_dir, page.fact), page), "first", "second")


for _page in _KPI_SQL:
    _register_page(_page)

# One choice per page that cuts through a dimension, as a reader of the page would make it.
_CHOSEN = {
    "page_01": {"service_service_name": ("Green Taxi", "Yellow Taxi"), "date_year": (2023,)},
    "page_02": {"pickup_hour": (7, 8, 9), "service_service_name": ("High Volume FHV",)},
    "page_03": {"payment_payment_name": ("Efectivo", "Disputa")},
    "page_04": {"anomaly_direction": ("HIGH",), "date_year": (2023,)},
    "page_05": {"origin_borough": ("ASIA", "EUROPE"), "destination_borough": ("AMERICA",)},
    "page_06": {"payment_payment_name": ("Tarjeta",), "pickup_hour": (0, 12, 23)},
}


def _register_sliced(name: str) -> None:
    page = PAGES[name]
    spec = FACTS[page.fact]
    block = _FACT_BLOCK[page.fact]
    blocks, joins, names = [block], [], []
    for role, link in spec.links.items():
        dimension, key, attributes = ROLES[role]
        blocks.append(_DIM_BLOCK[dimension])
        joins.append(f"LEFT JOIN {_DIM_BLOCK[dimension]} {role}_d ON f.{link} = {role}_d.{key}")
        names += [f"{role}_d.{n} AS {attribute(role, n)}" for n in attributes]
    chosen = " AND ".join(f"{c} IN ({', '.join(map(repr, values))})" for c, values in _CHOSEN[name].items())
    source = (
        f"(SELECT * FROM (SELECT f.*, {', '.join(names)} FROM (SELECT *, {_MONTHLY} AS month_start FROM {block}) f "
        f"{' '.join(joins)}) WHERE {chosen})"
    )
    oracle = sql(page_sql(source, *_KPI_SQL[name], page.category, page.date, page.series), *blocks)

    @query(f"{name}_sliced", oracle)
    def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = page_query(star(spark, sf_dir, page.fact), page, _CHOSEN[name])
        return tidied(rows, "first", "second")


for _page in _CHOSEN:
    _register_sliced(_page)


# --- contracts ------------------------------------------------------------------------------


def contract_sql(source: str, **columns: str) -> str:
    """Eleven contract columns, each given as SQL."""
    return "SELECT " + ", ".join(f"{text} AS {name}" for name, text in columns.items()) + f" FROM {source}"


_YEAR_MONTH = {"year": "pickup_year", "month": "pickup_month", "service": "service"}
_DAY = {"date": "strftime(pickup_date, '%Y-%m-%d')", **_YEAR_MONTH}
_MONTH = {"date": "strftime(make_date(pickup_year, pickup_month, 1), '%Y-%m-%d')", **_YEAR_MONTH}
_CONTRACT_SQL = {
    "D01_Resumen": ("daily", "demand", contract_sql(
        "daily", **_DAY, category="pickup_borough", series="service", metric_name="'Viajes e ingresos'",
        metric_value="trip_count::DOUBLE", metric_aux="total_revenue", status="'OK'",
        detail="'Resumen ejecutivo de demanda e ingresos'")),
    "D02_Demanda": ("hourly", "hourly", contract_sql(
        "hourly", **_DAY, category="CAST(pickup_hour AS VARCHAR)", series="service",
        metric_name="'Perfil horario de viajes'", metric_value="trip_count::DOUBLE",
        metric_aux="coalesce(avg_trip_duration_minutes, 0)", status="'OK'",
        detail="'Demanda por fecha, hora y servicio'")),
    "D03_Ingresos": ("finance", "finance", contract_sql(
        "finance", **_MONTH, category="CAST(payment_type AS VARCHAR)", series="service",
        metric_name="'Ingresos y propinas'", metric_value="total_revenue", metric_aux="tip_revenue",
        status="'OK'", detail="'Composición financiera por servicio y pago'")),
    "D04_Causas": ("anomalies", "anomalies", contract_sql(
        "anomalies", **_DAY, category="pickup_borough", series="anomaly_direction",
        metric_name="'Desviación de la demanda'", metric_value="demand_zscore", metric_aux="revenue_zscore",
        status="CASE WHEN is_anomaly THEN 'ANOMALÍA' ELSE 'NORMAL' END",
        detail="'Diagnóstico de cambios frente a la línea base'")),
    "D05_Rutas": ("routes", "routes", contract_sql(
        "routes", **_MONTH, category="pickup_zone || ' → ' || dropoff_zone", series="service",
        metric_name="'Rendimiento de rutas'", metric_value="trip_count::DOUBLE",
        metric_aux="coalesce(avg_trip_duration_minutes, 0)",
        status="CASE WHEN avg_speed_mph < 8 THEN 'LENTA' ELSE 'NORMAL' END",
        detail="'Volumen, duración y velocidad por ruta'")),
    "D06_Anomalias": ("tips", "tips", contract_sql(
        "tips", **_MONTH, category="pickup_borough", series="CAST(payment_type AS VARCHAR)",
        metric_name="'Factores de propina'",
        metric_value="coalesce(aggregate_tip_rate, avg_trip_tip_rate, 0)",
        metric_aux="coalesce(tipped_trip_share, 0)", status="'OK'",
        detail="'Propensión y tasa de propina por contexto'")),
}


def _register_contract(name: str) -> None:
    block, fact, body = _CONTRACT_SQL[name]
    rounded = ("metric_value", "metric_aux") if fact == "anomalies" else ()
    selected = f"SELECT * REPLACE ({tidy_sql(*rounded)}) FROM ({body})" if rounded else body

    @query(f"contract_{name[:3].lower()}", sql(selected, block))
    def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(build_contract(fact_rows(spark, sf_dir, fact), name), *rounded)


for _contract in _CONTRACT_SQL:
    _register_contract(_contract)
