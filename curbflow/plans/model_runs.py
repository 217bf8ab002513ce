"""The three models: demand forecast, zone segmentation, high-demand classification.

Training frames are panels with one row per entity and day. They are cached because several
actions read them, hashed on (entity, day) so that one busy entity spreads over many tasks, and
sorted inside partitions so that a seed gives the same trees on every run.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbflow.operators import series
from curbflow.operators.series import LAGS, ROLLING, TIME_FEATURES
from curbflow.operators.zone_features import ZONE_FEATURES, zone_features
from curbflow.session import cut_lineage
from curbflow.settings import ModelSettings

# Model names, segment labels in order of falling demand, split name.
FORECAST_MODEL = "time_series_gbt"
FORECAST_TAG = "gbt_calendar_lag"
SEGMENT_MODEL = "kmeans_zones"
CLASSIFY_MODEL = "random_forest_high_demand"
SEGMENT_LABELS = ("Muy alta demanda", "Alta demanda", "Demanda media", "Baja demanda")
TEST_SPLIT = "temporal_test"
CONFIDENCE_95 = 1.96
METRICS_SCHEMA = (
    "model_name string NOT NULL, metric_name string NOT NULL, metric_value double, "
    "metric_text string, generated_at_utc timestamp NOT NULL"
)
HISTORY = max(LAGS)
STEPS_PER_CHECKPOINT = 10
TRAINING_BYTES = 16 << 20


@dataclass
class ModelRun:
    """A fitted model with its metrics and result tables; ``release`` frees what it cached."""

    name: str
    metrics: dict[str, Any]
    frames: dict[str, DataFrame]
    model: PipelineModel
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for frame in self.cached:
            frame.unpersist()
        self.cached.clear()


def finite(value: float | None) -> float:
    return float(value) if value is not None and math.isfinite(value) else 0.0


def metrics_frame(spark: SparkSession, model: str, metrics: Mapping[str, Any]) -> DataFrame:
    """Tall metric rows: booleans as 0/1 with text, numbers as finite values, the rest as text."""
    now = datetime.now(timezone.utc)

    def row(name: str, value: Any) -> tuple:
        if isinstance(value, bool):
            return model, name, float(value), str(value).lower(), now
        if isinstance(value, (int, float)):
            return model, name, finite(value), None, now
        return model, name, None, None if value is None else str(value), now

    return spark.createDataFrame([row(n, metrics[n]) for n in sorted(metrics)], METRICS_SCHEMA)


def _training_order(frame: DataFrame, *keys: str) -> DataFrame:
    """The frame in partitions of TRAINING_BYTES, hashed on its keys and sorted inside.

    Trees are grown by many small jobs over the same rows, and a job lasts as long as its tasks take
    to start. So the number of partitions follows from the rows, which are counted once, and not
    from the shuffle setting.
    """
    rows = frame.persist()
    width = 16 + 8 * len(frame.columns)
    parts = max(1, -(-rows.count() * width // TRAINING_BYTES))
    laid = rows.repartition(parts, *keys).sortWithinPartitions(*keys).persist()
    laid.count()
    rows.unpersist()
    return laid


def _fit(pipeline: Pipeline, frame: DataFrame) -> PipelineModel:
    """Fit, and drop the training summary.

    A forest's summary refers to the session, which cannot be shipped to executors once anything
    in it has used ``observe``, as writing Silver does. A copy carries the trees alone.
    """
    return pipeline.fit(frame).copy()


def _split_features(panel: DataFrame, entity: str, test_days: int) -> DataFrame:
    complete = series.time_features(panel, entity=entity).dropna(subset=list(TIME_FEATURES))
    tagged = series.tag_split(complete, entity=entity, test_days=test_days)
    return _training_order(tagged, entity, "trip_date")


def _split_summary(frame: DataFrame, purpose: str) -> tuple[int, int, Any]:
    row = frame.agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.min(F.when(F.col("split") == "test", F.col("cutoff_date"))).alias("cutoff"),
    ).first()
    if row["train"] < 2 or row["test"] < 1 or row["train"] + row["test"] < 10:
        raise ValueError(f"{purpose} needs more history: train={row['train']} test={row['test']}")
    return row["train"], row["test"], row["cutoff"]


def _encoded(entity: str, *, one_hot: bool = True) -> list:
    """Features of an entity's days. Without ``one_hot`` the entity is one nominal feature: the index
    carries its categories as an attribute, and trees split on sets of them."""
    index = StringIndexer(
        inputCol=entity,
        outputCol="entity_index",
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    if not one_hot:
        return [index, VectorAssembler(inputCols=[*TIME_FEATURES, "entity_index"], outputCol="features")]
    return [
        index,
        OneHotEncoder(
            inputCols=["entity_index"],
            outputCols=["entity_vector"],
            handleInvalid="keep",
            dropLast=False,
        ),
        VectorAssembler(inputCols=[*TIME_FEATURES, "entity_vector"], outputCol="features"),
    ]


# --- forecast -------------------------------------------------------------------------------


def forecast_pipeline(settings: ModelSettings) -> Pipeline:
    trees = GBTRegressor(
        labelCol="trip_count",
        maxIter=settings.forecast_trees,
        maxDepth=settings.forecast_depth,
        lossType="squared",
        seed=settings.seed,
    )
    return Pipeline(stages=[*_encoded("service_type"), trees])


def _series_state(panel: DataFrame) -> DataFrame:
    """One row per series: its first and last date and its last 28 values, oldest first."""
    last = F.max("trip_date").over(Window.partitionBy("service_type"))
    first = F.min("trip_date").over(Window.partitionBy("service_type"))
    recent = panel.withColumns({"last_date": last, "first_date": first}).where(
        F.datediff("last_date", "trip_date") < HISTORY
    )
    ordered = F.array_sort(F.collect_list(F.struct("trip_date", "trip_count")))
    return recent.groupBy("service_type", "first_date", "last_date").agg(
        F.transform(ordered, lambda pair: pair["trip_count"]).alias("history")
    )


def _state_features(step: int) -> list[str]:
    """The time features of the step's date, from the carried history."""
    day = f"date_add(last_date, {step})"
    angle = f"{2.0 * math.pi!r}D * dayofyear({day}) / 365.25D"
    total = "aggregate(slice(history, -{k}, {k}), 0D, (a, v) -> a + v) / {k}D"
    return [
        f"CAST(dayofweek({day}) - 1 AS double) AS day_of_week",
        f"CAST(month({day}) AS double) AS month",
        f"CAST(dayofmonth({day}) AS double) AS day_of_month",
        f"CAST(dayofyear({day}) AS double) AS day_of_year",
        f"CAST(weekofyear({day}) AS double) AS week_of_year",
        f"CAST(dayofweek({day}) IN (1, 7) AS double) AS is_weekend",
        f"sin({angle}) AS sin_day_of_year",
        f"cos({angle}) AS cos_day_of_year",
        f"CAST(datediff({day}, first_date) AS double) AS trend_days",
        *(f"element_at(history, -{k}) AS lag_{k}" for k in LAGS),
        *(f"{total.format(k=k)} AS rolling_mean_{k}" for k in ROLLING),
    ]


def recursive_forecast(
    model: PipelineModel, panel: DataFrame, *, horizon_days: int, rmse: float
) -> DataFrame:
    """Predict day by day, each prediction entering the history of the next.

    State is one row per series that carries its last 28 values, so a step is a narrow projection:
    no shuffle and no window over the whole history. Lineage is cut every few steps only to keep
    the plan small.
    """
    state = cut_lineage(_series_state(panel))
    short = state.where(F.size("history") < HISTORY).count()
    if short:
        raise ValueError(f"{short} series have fewer than {HISTORY} days of history")
    # The series is encoded once; a step only assembles features and predicts.
    encode, predict = PipelineModel(model.stages[:2]), PipelineModel(model.stages[2:])
    fixed = ("service_type", "first_date", "last_date", "entity_vector")
    carried = (*fixed, "history", "path")
    state = encode.transform(state).withColumn("path", F.array().cast("array<double>"))
    for step in range(1, horizon_days + 1):
        scored = predict.transform(state.selectExpr(*carried, *_state_features(step)))
        floored = scored.selectExpr(*carried, "greatest(0D, prediction) AS next")
        state = floored.selectExpr(
            *fixed,
            f"slice(concat(history, array(next)), 2, {HISTORY}) AS history",
            "concat(path, array(next)) AS path",
        )
        if step % STEPS_PER_CHECKPOINT == 0 or step == horizon_days:
            state = cut_lineage(state)
    margin = f"{CONFIDENCE_95 * rmse!r}D"
    days = state.selectExpr(
        "service_type", "last_date", "posexplode(path) AS (position, forecast_trips)"
    ).selectExpr(
        "date_add(last_date, position + 1) AS forecast_date",
        "service_type",
        "forecast_trips",
        "position + 1 AS horizon_day",
    )
    return days.selectExpr(
        "*",
        f"greatest(0D, forecast_trips - {margin}) AS forecast_lower_95",
        f"forecast_trips + {margin} AS forecast_upper_95",
        f"'{FORECAST_TAG}' AS model_name",
        "forecast_date AS pickup_date",
        "service_type AS service",
        "forecast_date AS ds",
        "forecast_trips AS yhat",
        "current_timestamp() AS generated_at_utc",
    )


def run_forecast(daily: DataFrame, settings: ModelSettings = ModelSettings()) -> ModelRun:
    """Evaluate on each series' last days, then refit on everything and forecast ahead."""
    panel = series.complete_panel(series.daily_service(daily), entity="service_type").persist()
    frame = _split_features(panel, "service_type", settings.forecast_test_days)
    train_rows, test_rows, cutoff = _split_summary(frame, "forecasting")
    trial = _fit(forecast_pipeline(settings), frame.where("split = 'train'"))
    scored = trial.transform(frame.where("split = 'test'"))
    errors = series.forecast_errors(scored).first().asDict()
    model = _fit(forecast_pipeline(settings), frame)
    metrics = {
        **{n: finite(errors[n]) for n in ("rmse", "mae", "r2", "mape_percent", "wmape_percent")},
        "train_rows": train_rows,
        "test_rows": test_rows,
        "series_count": panel.agg(F.count_distinct("service_type")).first()[0],
        "forecast_horizon_days": settings.horizon_days,
        "temporal_cutoff": cutoff,
        "seed": settings.seed,
    }
    forecast = recursive_forecast(
        model, panel, horizon_days=settings.horizon_days, rmse=metrics["rmse"]
    )
    frames = {
        "forecast": forecast,
        "forecast_metrics": metrics_frame(daily.sparkSession, FORECAST_MODEL, metrics),
    }
    return ModelRun(FORECAST_MODEL, metrics, frames, model, [panel, frame])


# --- segmentation ---------------------------------------------------------------------------


def segment_pipeline(settings: ModelSettings) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(ZONE_FEATURES), outputCol="raw_features"),
            StandardScaler(
                inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True
            ),
            KMeans(
                featuresCol="scaled_features",
                predictionCol="segment_id",
                k=settings.clusters,
                maxIter=settings.cluster_iterations,
                initMode="k-means||",
                seed=settings.seed,
            ),
        ]
    )


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def segment_centres(model: PipelineModel) -> list[list[float]]:
    """The fitted centres in standardised features, in order of cluster."""
    return [[float(x) for x in centre] for centre in model.stages[-1].clusterCenters()]


def standardised(features: DataFrame) -> DataFrame:
    """Zones with their features as an array ``z`` of scores by sample deviation; a constant feature
    scores 0. One row of means and deviations is read for it."""
    stats = features.agg(
        *(F.avg(n).alias(f"mean_{n}") for n in ZONE_FEATURES),
        *(F.stddev_samp(n).alias(f"deviation_{n}") for n in ZONE_FEATURES),
    ).first()

    def score(name: str) -> Column:
        mean, deviation = stats[f"mean_{name}"], stats[f"deviation_{name}"]
        return (F.col(name) - mean) / deviation if deviation else F.lit(0.0)

    return features.withColumn("z", F.array(*(score(n) for n in ZONE_FEATURES)))


def nearest_centres(zones: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """``zones`` (with ``z``) and their nearest centre, ties to the smaller cluster: ``nearest_id``,
    ``nearest_distance`` (squared)."""
    def away(centre: Sequence[float]) -> Column:
        gap = F.zip_with("z", _numbers(centre), lambda a, b: a - b)
        return _dot(gap, gap)

    near = F.array_min(F.array(*(F.struct(away(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
    return zones.withColumn("_near", near).select(
        *zones.columns, F.col("_near.i").alias("nearest_id"), F.col("_near.d").alias("nearest_distance")
    )


def silhouettes(zones: DataFrame) -> DataFrame:
    """Silhouette of each zone (``segment_id``, ``z``) by squared distances; alone in a cluster it is 0.

    The mean squared distance from z to a cluster is |z|^2 + mean |y|^2 - 2 z . mean y, so one row of
    means a cluster stands for its members and no pair of zones is formed."""
    clusters = zones.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_dot(F.col("z"), F.col("z"))).alias("norm"),
        F.array(*(F.avg(F.col("z")[i]) for i in range(len(ZONE_FEATURES)))).alias("mean"),
    ).collect()

    def away(c: Any) -> Column:
        return _dot(F.col("z"), F.col("z")) + c["norm"] - 2 * _dot(F.col("z"), _numbers(c["mean"]))

    own = {c["segment_id"]: c for c in clusters}
    inside, outside = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, c in own.items():
        here = F.col("segment_id") == i
        inside = F.when(here, away(c) * (c["n"] / (c["n"] - 1)) if c["n"] > 1 else F.lit(None)).otherwise(inside)
        others = [away(o) for j, o in own.items() if j != i]
        outside = F.when(here, F.array_min(F.array(*others))).otherwise(outside)
    score = (F.col("_out") - F.col("_in")) / F.greatest("_in", "_out")
    return (
        zones.withColumns({"_in": inside, "_out": outside})
        .withColumn("silhouette", F.when(F.col("_in").isNull(), 0.0).when(F.greatest("_in", "_out") == 0, 0.0).otherwise(score))
        .drop("_in", "_out")
    )


def segment_profiles(assigned: DataFrame) -> DataFrame:
    """One row per cluster with its rank by demand, label and share of the network.

    The clusters, never more than k, are put in one array; its order is the rank and its sum the
    network.
    """
    means = [n for n in ZONE_FEATURES if n != "total_trips"]
    sums = assigned.groupBy("segment_id").agg(
        F.sum("total_trips").alias("total_trips"),
        F.count(F.lit(1)).alias("zone_count"),
        *(F.avg(n).alias(f"avg_{n}") for n in means),
    )
    member = F.struct(
        (-F.col("total_trips")).alias("falling"),
        F.col("segment_id").cast("int").alias("segment_id"),
        "zone_count",
        "total_trips",
        *(f"avg_{n}" for n in means),
    )
    ranked = sums.agg(F.array_sort(F.collect_list(member)).alias("clusters")).select(
        F.aggregate("clusters", F.lit(0.0), lambda total, c: total + c["total_trips"]).alias("network"),
        F.posexplode("clusters").alias("place", "c"),
    )
    labels = ", ".join(f"'{label}'" for label in SEGMENT_LABELS)
    return ranked.selectExpr(
        "c.segment_id",
        "c.zone_count",
        "c.total_trips",
        *(f"c.avg_{n}" for n in means),
        "place + 1 AS demand_rank",
        f"element_at(array({labels}), least(place + 1, {len(SEGMENT_LABELS)})) AS segment_label",
        "CASE WHEN network > 0 THEN c.total_trips / network ELSE 0D END AS trip_share",
        f"'{SEGMENT_MODEL}' AS model_name",
        "current_timestamp() AS generated_at_utc",
    )


def segment_rows(plain: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every zone with its features, cluster, label and rank, under the published names."""
    labelled = plain.join(
        profiles.select("segment_id", "segment_label", "demand_rank"), "segment_id", "left"
    )
    extra = {"zone_name": "pickup_zone", "borough": "pickup_borough"}
    return labelled.selectExpr(
        *(c for c in labelled.columns if c != "segment_id"),
        "CAST(segment_id AS int) AS segment_id",
        "try_cast(zone_id AS int) AS pickup_location_id",
        f"'{SEGMENT_MODEL}' AS model_name",
        "current_timestamp() AS generated_at_utc",
        *(f"{src} AS {dst}" for src, dst in extra.items() if src in plain.columns),
    )


def run_segmentation(source: DataFrame, settings: ModelSettings = ModelSettings()) -> ModelRun:
    """Cluster zones on standardised features; fails without k zones or k distinct vectors."""
    features = _training_order(zone_features(source), "zone_id")
    per_vector = features.groupBy(*ZONE_FEATURES).agg(F.count(F.lit(1)).alias("n"))
    size = per_vector.agg(F.sum("n").alias("zones"), F.count(F.lit(1)).alias("vectors")).first()
    zones, vectors = size["zones"] or 0, size["vectors"]
    if zones < settings.clusters or vectors < settings.clusters:
        raise ValueError(
            f"{settings.clusters} clusters need as many zones and distinct vectors: "
            f"zones={zones} vectors={vectors}"
        )
    model = _fit(segment_pipeline(settings), features)
    assigned = model.transform(features).persist()
    produced = assigned.agg(F.count_distinct("segment_id")).first()[0]
    if produced < 2:
        raise ValueError("segmentation produced a single cluster, silhouette is undefined")
    silhouette = ClusteringEvaluator(
        featuresCol="scaled_features",
        predictionCol="segment_id",
        metricName="silhouette",
        distanceMeasure="squaredEuclidean",
    ).evaluate(assigned)
    metrics = {
        "silhouette": finite(silhouette),
        "k": settings.clusters,
        "zones": zones,
        "clusters_produced": produced,
        "seed": settings.seed,
    }
    profiles = segment_profiles(assigned)
    plain = assigned.drop("raw_features", "scaled_features")
    segments = segment_rows(plain, profiles)
    frames = {
        "segments": segments,
        "profiles": profiles,
        "segment_metrics": metrics_frame(source.sparkSession, SEGMENT_MODEL, metrics),
    }
    return ModelRun(SEGMENT_MODEL, metrics, frames, model, [features, assigned])


# --- classification -------------------------------------------------------------------------


def classify_pipeline(settings: ModelSettings, zones: int = 0) -> Pipeline:
    """``zones``: how many there are, for trees over categories; bins must outnumber categories, the
    one for zones unseen in training included."""
    forest = RandomForestClassifier(
        maxBins=max(32, zones + 2) if settings.zones_as_categories else 32,
        labelCol="label",
        weightCol="class_weight",
        numTrees=settings.classify_trees,
        maxDepth=settings.classify_depth,
        subsamplingRate=1.0,
        featureSubsetStrategy="sqrt",
        seed=settings.seed,
    )
    return Pipeline(stages=[*_encoded("zone_id", one_hot=not settings.zones_as_categories), forest])


def confusion_counts(scored: DataFrame) -> DataFrame:
    """All four cells of the confusion matrix, zero where no row falls."""
    pairs = scored.select(
        F.col("label").cast("int").alias("actual_label"),
        F.col("prediction").cast("int").alias("predicted_label"),
    )
    grid = scored.sparkSession.sql(
        "SELECT * FROM VALUES (0, 0), (0, 1), (1, 0), (1, 1) AS grid(actual_label, predicted_label)"
    )
    counted = pairs.groupBy("actual_label", "predicted_label").agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counted, ["actual_label", "predicted_label"], "left").fillna(0, ["count"])


def weighted_scores(cells: Sequence[Mapping[str, int]]) -> dict[str, float]:
    """Accuracy and class-weighted precision, recall and F1 from the four cells."""
    count = {(c["actual_label"], c["predicted_label"]): c["count"] for c in cells}
    total = sum(count.values())
    scores = {"weighted_precision": 0.0, "weighted_recall": 0.0, "f1": 0.0}
    for label in (0, 1):
        hit = count[label, label]
        actual = hit + count[label, 1 - label]
        predicted = hit + count[1 - label, label]
        precision = hit / predicted if predicted else 0.0
        recall = hit / actual if actual else 0.0
        both = precision + recall
        share = actual / total
        scores["weighted_precision"] += share * precision
        scores["weighted_recall"] += share * recall
        scores["f1"] += share * (2 * precision * recall / both if both else 0.0)
    return {"accuracy": (count[0, 0] + count[1, 1]) / total, **scores}


def prediction_rows(scored: DataFrame, threshold: float, daily: DataFrame) -> DataFrame:
    """Holdout zone-days with label, prediction and probability, under the published names."""
    predictions = scored.selectExpr(
        "trip_date AS prediction_date",
        "zone_id",
        "trip_count AS actual_trips",
        f"{threshold!r}D AS high_demand_threshold",
        "CAST(label AS int) AS actual_high_demand",
        "CAST(prediction AS int) AS predicted_high_demand",
        "probability_high_demand",
        "cutoff_date AS temporal_cutoff",
        f"'{CLASSIFY_MODEL}' AS model_name",
        f"'{TEST_SPLIT}' AS dataset_split",
        "trip_date AS pickup_date",
        "try_cast(zone_id AS int) AS pickup_location_id",
        "label",
        "prediction",
        "current_timestamp() AS generated_at_utc",
    )
    if "zone_name" not in daily.columns:
        return predictions
    return predictions.join(series.largest_texts(daily, "zone_id", ["zone_name"]), "zone_id", "left")


def run_classification(source: DataFrame, settings: ModelSettings = ModelSettings()) -> ModelRun:
    """Learn which zone-days are busy; threshold and class weights come from training days only.

    Training needs both classes. A holdout of one class is scored like any other, but has no area
    under the ROC curve, which ranks one class against the other: that metric is null.
    """
    spark = source.sparkSession
    daily = series.zone_daily(source)
    panel = series.complete_panel(daily, entity="zone_id")
    frame = _split_features(panel, "zone_id", settings.classify_test_days)
    train_rows, test_rows, cutoff = _split_summary(frame, "classification")
    train = frame.where("split = 'train'")
    threshold = finite(
        series.demand_threshold(train, settings.high_demand_quantile).first()["threshold"]
    )
    if threshold <= 0:
        raise ValueError("no positive high-demand threshold in the training days")
    label = F.when(F.col("trip_count") >= threshold, 1.0).otherwise(0.0)
    labelled = train.withColumn("label", label)
    weights = {r["label"]: r["class_weight"] for r in series.class_weights(labelled).collect()}
    if set(weights) != {0, 1}:
        raise ValueError(f"training days need both classes, found {sorted(weights)}")
    weight = F.when(F.col("label") == 1.0, weights[1]).otherwise(weights[0])
    zones = train.agg(F.count_distinct("zone_id")).first()[0] if settings.zones_as_categories else 0
    model = _fit(classify_pipeline(settings, zones), labelled.withColumn("class_weight", weight))
    test = frame.where("split = 'test'").withColumn("label", label)
    scored = model.transform(test).persist()
    confusion = confusion_counts(scored)
    cells = [row.asDict() for row in confusion.collect()]
    auc = None
    if {c["actual_label"] for c in cells if c["count"]} == {0, 1}:
        judge = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
        auc = finite(judge.evaluate(scored))
    metrics = {
        "auc_roc": auc,
        **weighted_scores(cells),
        "high_demand_threshold": threshold,
        "high_demand_quantile": settings.high_demand_quantile,
        "train_rows": train_rows,
        "test_rows": test_rows,
        "temporal_cutoff": cutoff,
        "num_trees": settings.classify_trees,
        "seed": settings.seed,
    }
    predictions = prediction_rows(
        scored.withColumn("probability_high_demand", vector_to_array("probability")[1]), threshold, daily
    )
    stamped = confusion.selectExpr(
        "*", f"'{CLASSIFY_MODEL}' AS model_name", "current_timestamp() AS generated_at_utc"
    )
    frames = {
        "classification": predictions,
        "confusion": stamped,
        "classification_metrics": metrics_frame(spark, CLASSIFY_MODEL, metrics),
    }
    return ModelRun(CLASSIFY_MODEL, metrics, frames, model, [frame, scored])


def run_models(daily: DataFrame, settings: ModelSettings = ModelSettings()) -> dict[str, ModelRun]:
    return {
        "forecast": run_forecast(daily, settings),
        "segmentation": run_segmentation(daily, settings),
        "classification": run_classification(daily, settings),
    }


def all_metrics(runs: Mapping[str, ModelRun]) -> DataFrame:
    """Metric rows of every model in one tall table."""
    parts = [
        frame
        for run in runs.values()
        for name, frame in run.frames.items()
        if name.endswith("_metrics")
    ]
    return reduce(DataFrame.unionByName, parts)
