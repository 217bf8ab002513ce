"""Everything served from model tables, over tables that SQL can state as well.

The fitted models cannot be said in SQL, but what is built on their tables can: the same star,
page, contract, measure, profile, confusion and metric code runs here over stand-ins made by fixed
rules. Last week's trips are the forecast, total trips modulo three the segment, and a zone-day is
predicted busy if the same weekday a week earlier was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import series
from curbflow.operators.zone_features import zone_features
from curbflow.plans import dimensions as dims
from curbflow.plans.contracts import build_contract
from curbflow.plans.measures import measure_by
from curbflow.plans.model_runs import (
    CLASSIFY_MODEL,
    confusion_counts,
    metrics_frame,
    prediction_rows,
    segment_profiles,
    segment_rows,
    weighted_scores,
)
from curbflow.plans.pages import PAGES, page_query
from curbflow.plans.star import FACTS, star_join
from curbflow.plans.verification import METRIC_BOUNDS, metric_bounds
from curbflow.workload.model_queries import SETTINGS
from curbflow.workload.oracle_base import block, sql
from curbflow.workload.registry import query, tidied, tidy_sql
from curbflow.workload.semantic_queries import contract_sql, dimension_frames, page_sql
from curbflow.workload.trips import mart, written

# --- the stated tables ----------------------------------------------------------------------


def _forecast(daily: DataFrame) -> DataFrame:
    panel = series.complete_panel(series.daily_service(daily), entity="service_type")
    last = panel.groupBy("service_type").agg(F.max("trip_date").alias("last"))
    week = panel.join(last, "service_type").where("trip_date > date_sub(last, 7)")
    return week.selectExpr(
        "service_type AS service",
        "date_add(trip_date, 7) AS forecast_date",
        "datediff(trip_date, last) + 7 AS horizon_day",
        "trip_count AS forecast_trips",
        "greatest(0D, trip_count - 10) AS forecast_lower_95",
        "trip_count + 10 AS forecast_upper_95",
    )


def _assigned(daily: DataFrame) -> DataFrame:
    return zone_features(daily).withColumn("segment_id", (F.col("total_trips") % 3).cast("int"))


def _scored(daily: DataFrame) -> tuple[DataFrame, float]:
    panel = series.complete_panel(series.zone_daily(daily), entity="zone_id")
    features = series.time_features(panel, entity="zone_id").dropna(subset=list(series.TIME_FEATURES))
    split = series.tag_split(features, entity="zone_id", test_days=SETTINGS.classify_test_days)
    train = split.where("split = 'train'")
    threshold = series.demand_threshold(train, SETTINGS.high_demand_quantile).first()["threshold"]
    busy = F.lit(threshold)
    rows = split.where("split = 'test'").withColumns(
        {
            "label": (F.col("trip_count") >= busy).cast("double"),
            "prediction": (F.col("lag_7") >= busy).cast("double"),
            "probability_high_demand": F.col("lag_7") / (F.col("lag_7") + busy),
        }
    )
    return rows, threshold


def _metrics(daily: DataFrame) -> DataFrame:
    scored, threshold = _scored(daily)
    cells = [row.asDict() for row in confusion_counts(scored).collect()]  # four rows
    figures = {**weighted_scores(cells), "high_demand_threshold": threshold, "balanced": True, "note": "x"}
    return metrics_frame(daily.sparkSession, CLASSIFY_MODEL, figures)


BUILT = {
    "forecast": _forecast,
    "segments": lambda daily: segment_rows(_assigned(daily), segment_profiles(_assigned(daily))),
    "profiles": lambda daily: segment_profiles(_assigned(daily)),
    "classification": lambda daily: prediction_rows(*_scored(daily), series.zone_daily(daily)),
    "confusion": lambda daily: confusion_counts(_scored(daily)[0]),
    "metrics": _metrics,
}


def stated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return written(spark, sf_dir, f"stated-{name}", lambda: BUILT[name](mart(spark, sf_dir, "daily")))


block("stated_forecast", "panel", body="""
SELECT service_type AS service, trip_date + 7 AS forecast_date, CAST(trip_date - last + 7 AS INTEGER) AS horizon_day,
  trip_count AS forecast_trips, greatest(0.0::DOUBLE, trip_count - 10) AS forecast_lower_95, trip_count + 10 AS forecast_upper_95
FROM (SELECT *, max(trip_date) OVER (PARTITION BY service_type) AS last FROM panel) WHERE trip_date > last - 7
""")
block("stated_profiles", "zone_vectors", body="""
SELECT *, ['Muy alta demanda', 'Alta demanda', 'Demanda media', 'Baja demanda'][demand_rank] AS segment_label
FROM (SELECT *, CAST(row_number() OVER (ORDER BY total_trips DESC, segment_id) AS INTEGER) AS demand_rank,
  total_trips / sum(total_trips) OVER () AS trip_share
FROM (
  SELECT CAST(total_trips % 3 AS INTEGER) AS segment_id, count(*) AS zone_count, sum(total_trips) AS total_trips,
    avg(avg_daily_trips) AS avg_avg_daily_trips, avg(active_days) AS avg_active_days
  FROM zone_vectors GROUP BY 1
))
""")
block("stated_segments", "zone_vectors", "stated_profiles", body="""
SELECT v.*, p.demand_rank, p.segment_id, p.segment_label,
  CAST(v.zone_id AS INTEGER) AS pickup_location_id, v.zone_name AS pickup_zone, v.borough AS pickup_borough
FROM zone_vectors v JOIN stated_profiles p ON CAST(v.total_trips % 3 AS INTEGER) = p.segment_id
""")
block("stated_classification", "model_split", "zone_vectors", body="""
SELECT m.zone_id, m.trip_date AS prediction_date, m.trip_date AS pickup_date, trip_count AS actual_trips,
  CAST(trip_count >= t AS INTEGER) AS actual_high_demand, CAST(lag_7 >= t AS INTEGER) AS predicted_high_demand,
  lag_7 / (lag_7 + t) AS probability_high_demand, 'temporal_test' AS dataset_split, t::DOUBLE AS threshold,
  CAST(m.zone_id AS INTEGER) AS pickup_location_id, v.zone_name
FROM model_split m JOIN zone_vectors v ON m.zone_id = v.zone_id,
  (SELECT quantile_disc(trip_count, 0.75) AS t FROM model_split WHERE split = 'train' AND trip_count > 0)
WHERE split = 'test'
""")
block("stated_cells", "stated_classification", body="""
SELECT g.a AS actual_label, g.p AS predicted_label, count(c.zone_id) AS count
FROM (SELECT * FROM (SELECT CAST(unnest([0, 1]) AS INTEGER) AS a), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS p)) g
LEFT JOIN stated_classification c ON g.a = c.actual_high_demand AND g.p = c.predicted_high_demand
GROUP BY ALL
""")
block("stated_metrics", "stated_cells", "stated_classification", body="""
SELECT unnest(['accuracy', 'weighted_precision', 'weighted_recall', 'f1', 'high_demand_threshold', 'balanced', 'note']) AS metric_name,
  unnest([accuracy, wp, wr, f1, (SELECT max(threshold) FROM stated_classification), 1.0::DOUBLE, NULL]) AS metric_value
FROM (
  SELECT sum(hit) / sum(actual) AS accuracy, sum(actual * p) / sum(actual) AS wp, sum(actual * r) / sum(actual) AS wr,
    sum(actual * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(actual) AS f1
  FROM (
    SELECT hit, actual, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS r
    FROM (
      SELECT l, sum(count) FILTER (WHERE actual_label = l AND predicted_label = l)::DOUBLE AS hit,
        sum(count) FILTER (WHERE actual_label = l)::DOUBLE AS actual, sum(count) FILTER (WHERE predicted_label = l)::DOUBLE AS predicted
      FROM stated_cells, (SELECT unnest([0, 1]) AS l) GROUP BY l
    )
  )
)
""")

# --- tables and measures --------------------------------------------------------------------

_PROFILE = ("avg_avg_daily_trips", "avg_active_days", "trip_share")


@query("segment_profiles_stated", sql(
    f"SELECT segment_id, zone_count, total_trips, demand_rank, {tidy_sql(*_PROFILE)} FROM stated_profiles", "stated_profiles"))
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stated(spark, sf_dir, "profiles").select("segment_id", "zone_count", "total_trips", "demand_rank", *_PROFILE)
    return tidied(rows, *_PROFILE)


@query("confusion_matrix_stated", sql("SELECT actual_label, predicted_label, count FROM stated_cells", "stated_cells"))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, sf_dir, "confusion").select("actual_label", "predicted_label", "count")


@query("model_metrics_stated", sql(f"SELECT metric_name, {tidy_sql('metric_value')} FROM stated_metrics", "stated_metrics"))
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(stated(spark, sf_dir, "metrics").select("metric_name", "metric_value"), "metric_value")


_BOUNDS = ", ".join(
    f"('{m}', '{n}', {'NULL' if low is None else low}::DOUBLE, {'NULL' if high is None else high}::DOUBLE)"
    for m, n, low, high in METRIC_BOUNDS
)


@query("metric_bounds_stated", sql(f"""
SELECT b.model_name, b.metric_name, {tidy_sql('metric_value')},
  coalesce(metric_value >= coalesce(low, metric_value) AND metric_value <= coalesce(high, metric_value), false) AS in_range
FROM (VALUES {_BOUNDS}) b(model_name, metric_name, low, high)
LEFT JOIN stated_metrics m ON b.model_name = '{CLASSIFY_MODEL}' AND b.metric_name = m.metric_name
""", "stated_metrics"))
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that a run did not report are out of range."""
    return tidied(metric_bounds(stated(spark, sf_dir, "metrics")), "metric_value")


def _measured(name: str, fact: str, table: str, key: str, oracle: str, *rounded: str) -> None:
    @query(f"measures_{name}_stated", sql(f"SELECT * REPLACE ({tidy_sql(*rounded)}) FROM ({oracle})", f"stated_{table}"))
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(measure_by(stated(spark, sf_dir, fact), fact, (key,)), *rounded)


_measured("forecast", "forecast", "forecast", "service", """
SELECT service, sum(forecast_trips) AS forecast, sum(forecast_lower_95) AS lower, sum(forecast_upper_95) AS upper
FROM stated_forecast GROUP BY 1
""", "forecast")
_measured("segment", "segments", "segments", "demand_rank", """
SELECT demand_rank, count(DISTINCT pickup_location_id) AS zones, sum(total_trips) AS trips, sum(total_revenue) / sum(total_trips) AS revenue_per_trip
FROM stated_segments GROUP BY 1
""", "revenue_per_trip")
_measured("classify", "classification", "classification", "zone_name", """
SELECT zone_name, count(*) AS cases, count(*) FILTER (WHERE actual_high_demand = predicted_high_demand) AS hits,
  count(*) FILTER (WHERE actual_high_demand = predicted_high_demand) / count(*)::DOUBLE AS accuracy,
  avg(probability_high_demand) AS mean_probability
FROM stated_classification GROUP BY 1
""", "accuracy", "mean_probability")


@query("measures_confusion_stated", sql("""
SELECT predicted_label, CAST(sum(count) AS BIGINT) AS cases FROM stated_cells GROUP BY 1
""", "stated_cells"))
def measured_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_by(stated(spark, sf_dir, "confusion"), "confusion", ("predicted_label",))


# --- stars, pages and contracts -------------------------------------------------------------


def _star(spark: SparkSession, sf_dir: str, fact: str) -> DataFrame:
    frames = dimension_frames(spark, sf_dir)
    frames["cluster"] = dims.cluster_dimension(stated(spark, sf_dir, "segments"))
    return star_join(stated(spark, sf_dir, fact), FACTS[fact], frames)


def _served(fact: str, page: str, contract: str, star: str, first: str, second: str, body: str, *names: str) -> None:
    table = f"stated_{fact}"
    shown = PAGES[page]
    number = contract[1:3]

    @query(f"star_{fact}_stated", sql(star, table, "dim_days", "dim_services", "zones"))
    def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _star(spark, sf_dir, fact).select(*names)

    @query(f"{page}_stated", sql(
        page_sql(table, first, second, shown.category, shown.date, shown.series), table))
    def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(page_query(_star(spark, sf_dir, fact), shown), "first", "second")

    @query(f"contract_d{number}_stated", sql(
        f"SELECT * REPLACE ({tidy_sql('metric_value', 'metric_aux')}) FROM ({body})", table))
    def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(build_contract(stated(spark, sf_dir, fact), contract), "metric_value", "metric_aux")


_served("forecast", "page_07", "D07_Pronostico", """
SELECT f.service, f.forecast_date, f.horizon_day, f.forecast_trips, d.year AS date_year, d.month_name AS date_month_name,
  s.service_name AS service_service_name
FROM stated_forecast f LEFT JOIN dim_days d ON f.forecast_date = d.date LEFT JOIN dim_services s ON f.service = s.service
""", "sum(forecast_trips)", "sum(forecast_upper_95)", contract_sql(
    "stated_forecast", date="strftime(forecast_date, '%Y-%m-%d')", year="CAST(year(forecast_date) AS INTEGER)",
    month="CAST(month(forecast_date) AS INTEGER)", service="service", category="service", series="'Pronóstico'",
    metric_name="'Viajes pronosticados'", metric_value="forecast_trips", metric_aux="forecast_upper_95",
    status="'FORECAST'", detail="'Modelo GBT con calendario y rezagos'"),
    "service", "forecast_date", "horizon_day", "forecast_trips", "date_year", "date_month_name", "service_service_name")
_served("classification", "page_09", "D09_Clasificacion", """
SELECT c.zone_id, c.prediction_date, c.actual_trips, c.predicted_high_demand, d.year AS date_year, z.borough AS origin_borough, z.zone AS origin_zone
FROM stated_classification c LEFT JOIN dim_days d ON c.prediction_date = d.date LEFT JOIN zones z ON c.pickup_location_id = z.location_id
""", "count(*) FILTER (WHERE actual_high_demand = predicted_high_demand) / count(*)::DOUBLE", "count(*)", contract_sql(
    "stated_classification", date="strftime(prediction_date, '%Y-%m-%d')", year="CAST(year(prediction_date) AS INTEGER)",
    month="CAST(month(prediction_date) AS INTEGER)", service="'all'", category="zone_name",
    series="CASE WHEN predicted_high_demand = 1 THEN 'Alta' ELSE 'Normal' END",
    metric_name="'Probabilidad de alta demanda'", metric_value="probability_high_demand", metric_aux="actual_trips",
    status="CASE WHEN actual_high_demand = predicted_high_demand THEN 'ACIERTO' ELSE 'ERROR' END",
    detail="'Random Forest con validación temporal'"),
    "zone_id", "prediction_date", "actual_trips", "predicted_high_demand", "date_year", "origin_borough", "origin_zone")
_served("segments", "page_08", "D08_Segmentacion", """
SELECT s.zone_id, s.segment_id, s.segment_label, s.demand_rank, s.total_trips, z.borough AS origin_borough,
  'Segmento ' || s.segment_id AS cluster_segment_name
FROM stated_segments s LEFT JOIN zones z ON s.pickup_location_id = z.location_id
""", "count(DISTINCT pickup_location_id)", "sum(total_revenue) / sum(total_trips)", contract_sql(
    "stated_segments", date="'Periodo completo'", year="0", month="0", service="'all'", category="pickup_zone",
    series="segment_label", metric_name="'Segmentación de zonas'", metric_value="total_trips", metric_aux="total_revenue",
    status="'CLUSTER'", detail="'K-Means sobre demanda, ingresos y comportamiento'"),
    "zone_id", "segment_id", "segment_label", "demand_rank", "total_trips", "origin_borough", "cluster_segment_name")


# --- model pages with slicers and the model's own figure ------------------------------------

# Page -> fact, slicers, the same in SQL, its two measures, and which stated metric stands for the
# figure the page shows (name, scale), under which name.
_SLICED = {
    "page_07": (
        "forecast", {"date_year": (2023,), "horizon_day": (1, 2, 5)}, "year(forecast_date) = 2023 AND horizon_day IN (1, 2, 5)",
        "sum(forecast_trips)", "sum(forecast_upper_95)", ("accuracy", 100, "wmape_percent"),
    ),
    "page_08": (
        "segments", {"origin_borough": ("ASIA", "EUROPE")},
        "pickup_location_id IN (SELECT location_id FROM zones WHERE borough IN ('ASIA', 'EUROPE'))",
        "count(DISTINCT pickup_location_id)", "sum(total_revenue) / sum(total_trips)", ("f1", 1, "silhouette"),
    ),
    "page_09": (
        "classification", {"predicted_high_demand": (1,)}, "predicted_high_demand = 1",
        "count(*) FILTER (WHERE actual_high_demand = predicted_high_demand) / nullif(count(*), 0)::DOUBLE", "count(*)", ("weighted_recall", 1, "auc_roc"),
    ),
}


def _sliced(page: str) -> None:
    fact, chosen, condition, first, second, (metric, scale, stands_for) = _SLICED[page]
    shown = PAGES[page]
    rows = page_sql(f"(SELECT * FROM stated_{fact} WHERE {condition})", first, second, shown.category, shown.date, shown.series)

    @query(f"{page}_sliced", sql(f"""
SELECT * FROM ({rows}) UNION ALL
SELECT 'model', NULL, NULL, NULL, CASE WHEN round(v, 6) = 0 THEN 0.0::DOUBLE ELSE round(v, 6) END, NULL
FROM (SELECT max(metric_value) AS v FROM stated_metrics WHERE metric_name = '{metric}')
""", f"stated_{fact}", "stated_metrics", "zones"))
    def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The slicers reach every block but the model's."""
        figures = stated(spark, sf_dir, "metrics").where(f"metric_name = '{metric}'").withColumns(
            {"metric_name": F.lit(stands_for), "metric_value": F.col("metric_value") * scale}
        )
        return tidied(page_query(_star(spark, sf_dir, fact), shown, chosen, figures), "first", "second")


for _page in _SLICED:
    _sliced(_page)


@query("measures_model_stated", sql(f"""
SELECT * REPLACE ({tidy_sql("auc", "f1")}) FROM (
  SELECT max(metric_value) FILTER (WHERE metric_name = 'weighted_recall') AS auc, max(metric_value) FILTER (WHERE metric_name = 'f1') AS f1
  FROM stated_metrics)
""", "stated_metrics"))
def measured_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of model quality over tall metric rows; recall stands for the area under the curve."""
    named = F.when(F.col("metric_name") == "weighted_recall", "auc_roc").otherwise(F.col("metric_name"))
    rows = stated(spark, sf_dir, "metrics").withColumn("metric_name", named)
    return tidied(measure_by(rows, "classification_metrics"), "auc", "f1")
