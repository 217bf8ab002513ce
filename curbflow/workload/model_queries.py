"""Model runs over the daily mart, and everything served from their result tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import series
from curbflow.operators.zone_features import ZONE_FEATURES, zone_features
from curbflow.plans import dimensions as dims
from curbflow.plans import model_store
from curbflow.plans.contracts import build_contract
from curbflow.plans.measures import measure_by
from curbflow.plans.model_runs import (
    CLASSIFY_MODEL,
    FORECAST_MODEL,
    SEGMENT_MODEL,
    ModelRun,
    nearest_centres,
    recursive_forecast,
    run_classification,
    run_forecast,
    run_segmentation,
    segment_centres,
    silhouettes,
    standardised,
)
from curbflow.plans.pages import PAGES, page_query
from curbflow.plans.star import FACTS, star_join
from curbflow.plans.verification import check
from curbflow.session import scratch_path
from curbflow.settings import ModelSettings
from curbflow.sources import sinks
from curbflow.workload.oracle_base import sql
from curbflow.workload.registry import query, tidied, tidy_sql
from curbflow.workload.semantic_queries import dimension_frames
from curbflow.workload.trips import mart, written

SETTINGS = ModelSettings()
RUNNERS = {
    "forecast": (run_forecast, ("forecast", "forecast_metrics")),
    "segmentation": (run_segmentation, ("segments", "profiles", "segment_metrics")),
    "classification": (
        run_classification,
        ("classification", "confusion", "classification_metrics"),
    ),
}
_RUNS: dict[tuple[str, str, str], ModelRun] = {}


def result(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A model's result table, written once per session as the pipeline would."""
    for model, (runner, tables) in RUNNERS.items():
        if table in tables:
            slot = (spark.sparkContext.applicationId, sf_dir, model)
            if slot not in _RUNS:
                run = _RUNS[slot] = runner(mart(spark, sf_dir, "daily"), SETTINGS)
                for name in tables:
                    written(spark, sf_dir, name, lambda name=name: run.frames[name])
                run.release()
            return written(spark, sf_dir, table, lambda: _RUNS[slot].frames[table])
    raise KeyError(table)


def _register_table(name: str, table: str, *columns: str) -> None:
    @query(name)
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return result(spark, sf_dir, table).select(*columns)


_register_table(
    "forecast", "forecast",
    "service", "forecast_date", "horizon_day", "forecast_trips",
    "forecast_lower_95", "forecast_upper_95", "model_name",
)
_register_table(
    "segment_zones", "segments",
    "zone_id", "pickup_zone", "segment_id", "segment_label", "demand_rank", "total_trips",
)
_register_table(
    "segment_profiles", "profiles",
    "segment_id", "segment_label", "demand_rank", "zone_count", "total_trips", "trip_share",
)
_register_table(
    "classify_demand", "classification",
    "zone_id", "zone_name", "prediction_date", "actual_trips", "actual_high_demand",
    "predicted_high_demand", "probability_high_demand",
)
_register_table(
    "confusion_matrix", "confusion", "actual_label", "predicted_label", "count"
)


# --- the parts of the model tables that SQL can state ---------------------------------------


@query("forecast_calendar", sql("""
SELECT service_type AS service, last_day + CAST(h AS INTEGER) AS forecast_date, CAST(h AS INTEGER) AS horizon_day
FROM (SELECT service_type, max(trip_date) AS last_day FROM service_day GROUP BY 1), (SELECT unnest(range(1, 31)) AS h)
""", "service_day"))
def forecast_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series is forecast for each of the 30 days after its own last day."""
    return result(spark, sf_dir, "forecast").select("service", "forecast_date", "horizon_day")


_SEGMENT_R = ("total_trips", "avg_daily_trips", "demand_stddev", "avg_fare_amount", "total_revenue")


@query("segment_inputs", sql(
    f"SELECT * REPLACE ({tidy_sql(*_SEGMENT_R)}) FROM (SELECT zone_id, zone_name, borough, active_days, {', '.join(_SEGMENT_R)} FROM zone_vectors)",
    "zone_vectors"))
def segment_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation keeps every zone with the features it was clustered on."""
    rows = result(spark, sf_dir, "segments").select(
        "zone_id", "zone_name", "borough", "active_days", *_SEGMENT_R
    )
    return tidied(rows, *_SEGMENT_R)


@query("classification_actuals", sql("""
SELECT zone_id, trip_date AS prediction_date, trip_count AS actual_trips, cutoff_date AS temporal_cutoff, t::DOUBLE AS high_demand_threshold,
  CAST(trip_count >= t AS INTEGER) AS actual_high_demand
FROM model_split, (SELECT quantile_disc(trip_count, 0.75) AS t FROM model_split WHERE split = 'train' AND trip_count > 0)
WHERE split = 'test'
""", "model_split"))
def classification_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, sf_dir, "classification").select(
        "zone_id",
        "prediction_date",
        "actual_trips",
        "temporal_cutoff",
        "high_demand_threshold",
        "actual_high_demand",
    )


# --- served from the result tables ----------------------------------------------------------


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [result(spark, sf_dir, f"{m}_metrics") for m in ("forecast", "segment", "classification")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("model_metrics")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("model_name", "metric_name", "metric_value", "metric_text")


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    segments = result(spark, sf_dir, "segments")
    return {**dimension_frames(spark, sf_dir), "cluster": dims.cluster_dimension(segments)}


def _star(spark: SparkSession, sf_dir: str, fact: str) -> DataFrame:
    return star_join(result(spark, sf_dir, fact), FACTS[fact], frames(spark, sf_dir))


def _register_served(fact: str, page: str, contract: str) -> None:
    @query(f"star_{fact}")
    def star(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _star(spark, sf_dir, fact).drop("generated_at_utc")

    @query(page)
    def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = PAGES[page]
        model = result(spark, sf_dir, shown.model_metric[0])
        return page_query(_star(spark, sf_dir, fact), shown, model_metrics=model)

    @query(contract[:3].lower().replace("d", "contract_d"))
    def served(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build_contract(result(spark, sf_dir, fact), contract)


_register_served("forecast", "page_07", "D07_Pronostico")
_register_served("segments", "page_08", "D08_Segmentacion")
_register_served("classification", "page_09", "D09_Clasificacion")


@query("star_profiles")
def star_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir, "profiles").drop("generated_at_utc")


@query("dim_cluster")
def dim_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.cluster_dimension(result(spark, sf_dir, "segments"))


@query("measures_forecast")
def measures_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_by(result(spark, sf_dir, "forecast"), "forecast", ("service",))


@query("measures_segment")
def measures_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_by(result(spark, sf_dir, "segments"), "segments", ("segment_label",))


@query("measures_classify")
def measures_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_by(result(spark, sf_dir, "classification"), "classification", ("zone_name",))


@query("measures_confusion", sql("""
SELECT CAST(trip_count >= t AS INTEGER) AS actual_label, count(*) AS cases
FROM model_split, (SELECT quantile_disc(trip_count, 0.75) AS t FROM model_split WHERE split = 'train' AND trip_count > 0)
WHERE split = 'test' GROUP BY 1
""", "model_split"))
def measures_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each class that the holdout has; cells in which no row falls stand for no case."""
    return measure_by(result(spark, sf_dir, "confusion").where("count > 0"), "confusion", ("actual_label",))


# --- properties of the fitted models --------------------------------------------------------


@query("forecast_bounds", sql("""
SELECT service_type AS service, CAST(30 AS BIGINT) AS days, true AS bounds_hold FROM service_day GROUP BY 1
""", "service_day"))
def forecast_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bound lies 1.96 RMSE from its forecast, the lower one not below zero."""
    rmse = F.expr("max(metric_value) FILTER (WHERE metric_name = 'rmse')")
    error = result(spark, sf_dir, "forecast_metrics").agg(rmse.alias("rmse")).first()["rmse"]
    margin = F.lit(1.96 * error)
    trips = F.col("forecast_trips")
    holds = (
        (trips >= 0)
        & (F.abs(F.col("forecast_upper_95") - trips - margin) < 1e-6)
        & (F.abs(F.col("forecast_lower_95") - F.greatest(trips - margin, F.lit(0.0))) < 1e-6)
    )
    return (
        result(spark, sf_dir, "forecast").groupBy("service")
        .agg(F.count(F.lit(1)).alias("days"), F.bool_and(holds).alias("bounds_hold"))
    )


@query("segment_conservation", sql("""
SELECT count(*) AS zones, sum(total_trips) AS trips, true AS profiles_agree FROM zone_vectors
""", "zone_vectors"))
def segment_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments keep every zone and trip, and profiles are the sums of their own members."""
    segments = result(spark, sf_dir, "segments")
    own = segments.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_trips").alias("t")
    )
    agree = result(spark, sf_dir, "profiles").join(own, "segment_id", "left").agg(
        F.bool_and((F.col("n") == F.col("zone_count")) & (F.col("t") == F.col("total_trips"))).alias("profiles_agree"),
        F.sum("n").alias("zones"),
        F.sum("t").alias("trips"),
    )
    return agree.select("zones", "trips", "profiles_agree")


@query("confusion_recount", sql("""
SELECT CAST(a AS INTEGER) AS actual_label, CAST(p AS INTEGER) AS predicted_label, true AS agrees
FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS p)
"""))
def confusion_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell of the matrix equals a count over the published predictions."""
    rows = result(spark, sf_dir, "classification").groupBy(
        F.col("actual_high_demand").alias("actual_label"),
        F.col("predicted_high_demand").alias("predicted_label"),
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = result(spark, sf_dir, "confusion").select("actual_label", "predicted_label", "count")
    joined = cells.join(rows, ["actual_label", "predicted_label"], "left")
    return joined.select(
        "actual_label", "predicted_label", (F.col("count") == F.coalesce("n", F.lit(0))).alias("agrees")
    )


@query("classification_accuracy", sql("SELECT true AS accuracy_agrees, true AS probability_agrees"))
def classification_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published accuracy from the published rows; the class follows the probability."""
    accuracy = F.expr("max(metric_value) FILTER (WHERE metric_name = 'accuracy')")
    stated = result(spark, sf_dir, "classification_metrics").agg(accuracy.alias("a")).first()["a"]
    hit = (F.col("actual_high_demand") == F.col("predicted_high_demand")).cast("double")
    side = (F.col("probability_high_demand") > 0.5) == (F.col("predicted_high_demand") == 1)
    close = F.abs(F.col("probability_high_demand") - 0.5) < 1e-9
    return result(spark, sf_dir, "classification").agg(
        (F.abs(F.avg(hit) - F.lit(stated)) < 1e-9).alias("accuracy_agrees"),
        F.bool_and(side | close).alias("probability_agrees"),
    )


@query("measures_model")
def measures_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline quality of each model, one row per measure."""
    parts = []
    for fact in ("forecast_metrics", "segment_metrics", "classification_metrics"):
        wide = measure_by(result(spark, sf_dir, fact), fact)
        parts.append(wide.unpivot([], wide.columns, "measure", "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- the segmentation, from its centres ------------------------------------------------------

_Z = ", ".join(
    f"(CASE WHEN stddev_samp({n}) OVER () > 0 THEN ({n} - avg({n}) OVER ()) / stddev_samp({n}) OVER () ELSE 0 END)::DOUBLE AS z_{n}"
    for n in ZONE_FEATURES
)
_Z_R = tuple(f"z_{n}" for n in ZONE_FEATURES)


@query("segment_nearest", sql(f"""
SELECT zone_id, true AS nearest_is_own, true AS as_scaled, {tidy_sql(*_Z_R)} FROM (SELECT zone_id, {_Z} FROM zone_vectors)
""", "zone_vectors"))
def segment_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with features standardised in SQL: they are those the model clustered, and the centre
    nearest by them, of the centres read from the fitted model, is the zone's own."""
    run = fitted(spark, sf_dir, "segmentation")["segmentation"]
    features = zone_features(mart(spark, sf_dir, "daily"))
    scaled = run.model.transform(features).select("zone_id", "segment_id", vector_to_array("scaled_features").alias("scaled"))
    zones = nearest_centres(standardised(features), segment_centres(run.model)).join(scaled, "zone_id")
    gap = F.array_max(F.zip_with("z", "scaled", lambda a, b: F.abs(a - b)))
    return tidied(zones.select(
        "zone_id", (F.col("nearest_id") == F.col("segment_id")).alias("nearest_is_own"), (gap < 1e-9).alias("as_scaled"),
        *(F.col("z")[i].alias(name) for i, name in enumerate(_Z_R)),
    ), *_Z_R)


@query("segment_cohesion", sql("""
SELECT count(*) AS zones, true AS mean_is_metric, true AS each_in_range FROM zone_vectors
""", "zone_vectors"))
def segment_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes recomputed from standardised features and assignments; their mean is the metric."""
    run = fitted(spark, sf_dir, "segmentation")["segmentation"]
    features = zone_features(mart(spark, sf_dir, "daily"))
    own = result(spark, sf_dir, "segments").select("zone_id", "segment_id")
    each = silhouettes(standardised(features).join(own, "zone_id"))
    return each.agg(
        F.count(F.lit(1)).alias("zones"),
        (F.abs(F.avg("silhouette") - run.metrics["silhouette"]) < 1e-9).alias("mean_is_metric"),
        F.every(F.col("silhouette").between(-1, 1)).alias("each_in_range"),
    )


# --- stored models --------------------------------------------------------------------------


def fitted(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, ModelRun]:
    """Runs of this session, all three or those named, fitted where they are not yet."""
    wanted = names or tuple(RUNNERS)
    for name in wanted:
        result(spark, sf_dir, RUNNERS[name][1][0])
    return {m: _RUNS[spark.sparkContext.applicationId, sf_dir, m] for m in wanted}


def stored_models(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """The three runs' models, saved below a folder of the shared store: name -> path."""
    paths = {}
    for run in fitted(spark, sf_dir).values():
        paths[run.name] = f"{folder}/{run.name}"
        model_store.publish_model(run, paths[run.name], spark)
    return paths


_CUTOFF = "(SELECT min(last) - 90 FROM (SELECT max(trip_date) AS last FROM {rows} WHERE lag_28 IS NOT NULL GROUP BY {entity}))"


@query("loaded_predictions", sql(f"""
SELECT 'time_series_gbt' AS model_name, count(*) AS predictions, count(*) FILTER (WHERE trip_date > {_CUTOFF.format(rows="features", entity="service_type")}) AS new_rows,
  CAST(0 AS BIGINT) AS differing FROM features WHERE lag_28 IS NOT NULL
UNION ALL SELECT 'random_forest_high_demand', count(*), count(*) FILTER (WHERE trip_date > {_CUTOFF.format(rows="zone_time", entity="zone_id")}),
  0 FROM zone_time WHERE lag_28 IS NOT NULL
UNION ALL SELECT 'kmeans_zones', count(*), count(*), 0 FROM zone_vectors
""", "features", "zone_time", "zone_vectors"))
def loaded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models read back from their folders predict as the fitted ones do, row by row, and know from
    their cards which days are new to them."""
    daily = mart(spark, sf_dir, "daily")
    paths = stored_models(spark, sf_dir, scratch_path(spark, "models"))
    parts = []
    for run in fitted(spark, sf_dir).values():
        stored = model_store.load_model(spark, paths[run.name])
        own = replace(stored, model=run.model)
        rows = model_store.feature_rows(run.name, daily)
        both = model_store.predict(stored, model_store.predict(own, rows, "fitted"), "loaded")
        fresh = F.lit(True) if stored.cutoff is None else F.col("trip_date") > F.lit(stored.cutoff)
        parts.append(both.agg(
            F.lit(run.name).alias("model_name"), F.count(F.lit(1)).alias("predictions"), F.count_if(fresh).alias("new_rows"),
            F.count_if(~F.col("fitted").eqNullSafe(F.col("loaded"))).alias("differing"),
        ))
    return reduce(DataFrame.unionByName, parts)


@query("stored_model_faults", """
SELECT * FROM (VALUES ('as saved', true, 0::BIGINT), ('faulty', false, 3)) t("check", passed, violations)
""")
def stored_model_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's folder is gone, one has lost its card, one lies where another belongs."""
    paths = stored_models(spark, sf_dir, scratch_path(spark, "models"))
    whole = check("as saved", model_store.unusable_models(spark, paths), "models cannot be used").select("check", "passed", "violations")
    sinks.delete_path(spark, f"{paths[FORECAST_MODEL]}/stages")
    sinks.delete_path(spark, f"{paths[CLASSIFY_MODEL]}/card")
    moved = {**paths, SEGMENT_MODEL: stored_models(spark, sf_dir, scratch_path(spark, "models"))[FORECAST_MODEL]}
    broken = check("faulty", model_store.unusable_models(spark, moved), "models cannot be used").select("check", "passed", "violations")
    return whole.unionByName(broken)


# --- the recursion, with a model that SQL can state -----------------------------------------

# Next day's trips by this line; it uses lags, a trailing mean and the calendar, and falls below zero.
LINE = "0.5 * {lag_1} + 0.25 * {lag_7} + 0.25 * {mean} + 0.75 * ({day} - 4) - 0.05 * {trend}"


def line_model(panel: DataFrame) -> PipelineModel:
    encode = Pipeline(stages=[
        StringIndexer(inputCol="service_type", outputCol="entity_index", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["entity_index"], outputCols=["entity_vector"], dropLast=False),
    ]).fit(panel)
    line = LINE.format(lag_1="lag_1", lag_7="lag_7", mean="rolling_mean_28", day="day_of_week", trend="trend_days")
    return PipelineModel([*encode.stages, SQLTransformer(statement=f"SELECT *, CAST({line} AS double) AS prediction FROM __THIS__")])


_STEP = LINE.format(
    lag_1="history[28]", lag_7="history[22]", mean="(list_sum(history) / 28)", day="dayofweek(last + h + 1)", trend="(last + h + 1 - first)"
)


@query("forecast_recursion_stated", sql(f"""
SELECT service, forecast_date, horizon_day, {tidy_sql("forecast_trips", "forecast_lower_95")}
FROM (
  WITH RECURSIVE walk AS (
    SELECT service_type, first, last, 0 AS h, history, NULL::DOUBLE AS next FROM (
      SELECT service_type, min(trip_date) AS first, max(trip_date) AS last,
        list(trip_count ORDER BY trip_date)[-28:] AS history FROM panel GROUP BY service_type)
    UNION ALL
    SELECT service_type, first, last, h + 1, list_append(history[2:], value), value FROM (
      SELECT *, greatest(0.0::DOUBLE, {_STEP}) AS value FROM walk WHERE h < 30)
  )
  SELECT service_type AS service, CAST(last + h AS DATE) AS forecast_date, CAST(h AS INTEGER) AS horizon_day, next AS forecast_trips,
    greatest(0.0::DOUBLE, next - 1.96 * 12.5) AS forecast_lower_95
  FROM walk WHERE h > 0)
""", "panel"))
def forecast_recursion_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days ahead, each prediction entering the history of the next, with a line as model."""
    panel = series.complete_panel(series.daily_service(mart(spark, sf_dir, "daily")), entity="service_type")
    ahead = recursive_forecast(line_model(panel), panel, horizon_days=30, rmse=12.5)
    rows = ahead.select("service", "forecast_date", F.col("horizon_day").cast("int").alias("horizon_day"), "forecast_trips", "forecast_lower_95")
    return tidied(rows, "forecast_trips", "forecast_lower_95")
