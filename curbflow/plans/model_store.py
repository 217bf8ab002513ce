"""Fitted models as stored things: saved with a card, loaded again, scored on new days, verified."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.operators import series
from curbflow.operators.series import TIME_FEATURES
from curbflow.operators.zone_features import ZONE_FEATURES, zone_features
from curbflow.plans.model_runs import CLASSIFY_MODEL, FORECAST_MODEL, SEGMENT_MODEL, ModelRun

CARD_SCHEMA = "model_name string, entity string, features array<string>, prediction string, cutoff string, stages int"


@dataclass(frozen=True)
class Kind:
    """What a model is applied to: its entity, inputs, prediction column and feature rows."""

    entity: str
    features: tuple[str, ...]
    prediction: str
    rows: Callable[[DataFrame], DataFrame]


def _days(daily: DataFrame, entity: str) -> DataFrame:
    panel = series.complete_panel(daily, entity=entity)
    return series.time_features(panel, entity=entity).dropna(subset=list(TIME_FEATURES))


KINDS = {
    FORECAST_MODEL: Kind("service_type", TIME_FEATURES, "prediction", lambda d: _days(series.daily_service(d), "service_type")),
    CLASSIFY_MODEL: Kind("zone_id", TIME_FEATURES, "prediction", lambda d: _days(series.zone_daily(d), "zone_id")),
    SEGMENT_MODEL: Kind("zone_id", ZONE_FEATURES, "segment_id", zone_features),
}


@dataclass(frozen=True)
class StoredModel:
    name: str
    entity: str
    features: tuple[str, ...]
    prediction: str
    cutoff: date | None
    model: PipelineModel


def publish_model(run: ModelRun, path: str, spark: SparkSession) -> None:
    """Save the fitted pipeline and, beside it, its card: the columns it needs and the last day it
    may have learned from. The card comes last and goes with an overwritten model, so a half-saved one has none."""
    kind, cutoff = KINDS[run.name], run.metrics.get("temporal_cutoff")
    run.model.write().overwrite().save(path)
    card = (run.name, kind.entity, list(kind.features), kind.prediction, None if cutoff is None else str(cutoff), len(run.model.stages))
    spark.createDataFrame([card], CARD_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/card")


def load_model(spark: SparkSession, path: str) -> StoredModel:
    """The model of ``publish_model``; an absent, foreign or incomplete one is an error."""
    card = spark.read.schema(CARD_SCHEMA).json(f"{path}/card").first()
    if card is None or card["model_name"] not in KINDS:
        raise ValueError(f"{path} has no card of a known model")
    model = PipelineModel.load(path)
    if len(model.stages) != card["stages"]:
        raise ValueError(f"{path} has {len(model.stages)} of {card['stages']} stages")
    cutoff = date.fromisoformat(card["cutoff"]) if card["cutoff"] else None
    return StoredModel(card["model_name"], card["entity"], tuple(card["features"]), card["prediction"], cutoff, model)


def feature_rows(name: str, daily: DataFrame) -> DataFrame:
    """The rows a model is applied to, from the daily mart, as they were built for its fit."""
    return KINDS[name].rows(daily)


def predict(stored: StoredModel, rows: DataFrame, column: str = "prediction") -> DataFrame:
    """``rows`` with the stored model's prediction in ``column``; nothing is fitted again."""
    absent = sorted({stored.entity, *stored.features} - set(rows.columns))
    if absent:
        raise ValueError(f"{stored.name} needs columns {absent}")
    kept = [c for c in rows.columns if c != column]
    scored = stored.model.transform(rows.select(*kept))
    return scored.select(*kept, F.col(stored.prediction).cast("double").alias(column))


def new_days(stored: StoredModel, rows: DataFrame) -> DataFrame:
    """Rows of days the fit's training side ended before; of a model without days, all."""
    return rows if stored.cutoff is None else rows.where(F.col("trip_date") > F.lit(stored.cutoff))


def unusable_models(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Those of ``paths`` (by model name) that cannot be loaded, or hold another model."""
    bad = []
    for name, path in paths.items():
        try:
            found = load_model(spark, path).name
            if found != name:
                bad.append((name, f"holds {found}"))
        except (PySparkException, ValueError) as e:
            bad.append((name, str(e).splitlines()[0][:200]))
        except Exception as e:  # noqa: BLE001  a loader's own errors arrive as the JVM's
            if "py4j" not in type(e).__module__:
                raise
            bad.append((name, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(bad, "name string, reason string")
