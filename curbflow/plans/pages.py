"""Report pages as one grouping-sets query each.

A page shows two totals, the first measure by category (bars and ring), the first measure by date
and series (trend), and the second measure by series. One scan of the star answers all of them:
the sets are expanded before the partial aggregate, so only small partial rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.plans.measures import measure


class Page(NamedTuple):
    title: str  # fixed value
    fact: str
    first: str
    second: str
    category: str
    date: str
    series: str
    slicers: tuple[str, ...]
    model_metric: tuple[str, str] | None = None


PAGES = {
    "page_01": Page(
        "01 Resumen ejecutivo", "demand", "trips", "revenue",
        "pickup_borough", "pickup_date", "service", ("date_year", "service_service_name"),
    ),
    "page_02": Page(
        "02 Demanda temporal", "hourly", "trips", "weighted_duration",
        "pickup_hour", "pickup_date", "service",
        ("date_year", "service_service_name", "pickup_hour"),
    ),
    "page_03": Page(
        "03 Ingresos y tarifas", "finance", "revenue", "tip_rate",
        "payment_type", "month_start", "service",
        ("date_year", "service_service_name", "payment_payment_name"),
    ),
    "page_04": Page(
        "04 Causas del cambio", "anomalies", "anomalies", "anomaly_share",
        "anomaly_direction", "pickup_date", "service",
        ("date_year", "service_service_name", "anomaly_direction"),
    ),
    "page_05": Page(
        "05 Rutas y congestión", "routes", "trips", "weighted_duration",
        "pickup_zone", "month_start", "service",
        ("date_year", "service_service_name", "origin_borough", "destination_borough"),
    ),
    "page_06": Page(
        "06 Propinas y anomalías", "tips", "tip_rate", "tipped_share",
        "pickup_borough", "month_start", "service",
        ("date_year", "service_service_name", "payment_payment_name", "pickup_hour"),
    ),
    "page_07": Page(
        "07 Pronóstico de demanda", "forecast", "forecast", "upper",
        "service", "forecast_date", "service",
        ("date_year", "service_service_name", "horizon_day"), ("forecast_metrics", "wmape"),
    ),
    "page_08": Page(
        "08 Segmentación de zonas", "segments", "zones", "revenue_per_trip",
        "segment_label", "pickup_location_id", "borough",
        ("cluster_segment_name", "origin_borough"), ("segment_metrics", "silhouette"),
    ),
    "page_09": Page(
        "09 Clasificación de alta demanda", "classification", "accuracy", "cases",
        "dataset_split", "prediction_date", "predicted_high_demand",
        ("date_year", "dataset_split", "predicted_high_demand"), ("classification_metrics", "auc"),
    ),
    "page_10": Page(
        "10 Control y auditoría", "audit", "events", "events_ok",
        "category", "date", "series", ("status", "service"),
    ),
}

# grouping_id over (category, date, series) -> block of the page.
BLOCKS = {7: "total", 3: "by_category", 4: "trend", 6: "by_series"}


def slicer_filter(page: Page, chosen: Mapping[str, Sequence[object]]) -> Column:
    """Conjunction of the chosen slicer values; only the page's own slicers are allowed."""
    unknown = set(chosen) - set(page.slicers)
    if unknown:
        raise ValueError(f"{page.title} has no slicer {sorted(unknown)}")
    condition = F.lit(True)
    for name, values in chosen.items():
        condition = condition & F.col(name).isin(list(values))
    return condition


def page_query(
    star: DataFrame,
    page: Page,
    chosen: Mapping[str, Sequence[object]] | None = None,
    model_metrics: DataFrame | None = None,
) -> DataFrame:
    """Blocks of the page as (block, category, date, series, first, second), in reading order:
    totals, categories by falling first measure, trend by rising date, series. A page of a model
    has a block ``model`` with the model's own figure, which no slicer changes. The totals are there
    when no row is chosen, as the measures of no rows; grouping sets alone would then be empty."""
    rows = star.where(slicer_filter(page, chosen)) if chosen else star
    shaped = rows.selectExpr(
        "*",
        f"CAST({page.category} AS string) AS _category",
        f"CAST({page.date} AS string) AS _date",
        f"CAST({page.series} AS string) AS _series",
    )
    sets = [[], ["_category"], ["_date", "_series"], ["_series"]]
    shown = [F.expr(measure(page.fact, m)).cast("double").alias(n) for m, n in ((page.first, "first"), (page.second, "second"))]
    counted = shaped.groupingSets(sets, "_category", "_date", "_series").agg(
        *shown, F.expr("CAST(grouping_id() AS int)").alias("set_id")
    )
    nothing = shaped.limit(0).agg(*shown).withColumn("set_id", F.lit(7))
    keys = ("set_id", "_category", "_date", "_series")
    both = counted.withColumn("rank", F.lit(1)).unionByName(nothing.withColumn("rank", F.lit(0)), allowMissingColumns=True)
    grouped = both.groupBy(*keys).agg(F.max_by(F.struct("first", "second"), "rank").alias("shown")).select(*keys, "shown.*")
    labels = " ".join(f"WHEN {i} THEN '{name}'" for i, name in BLOCKS.items())
    blocks = grouped.selectExpr(
        f"CASE set_id {labels} END AS block",
        "_category AS category",
        "_date AS date",
        "_series AS series",
        "first",
        "second",
    )
    if page.model_metric and model_metrics is not None:
        figure = model_metrics.agg(F.expr(measure(*page.model_metric)).cast("double").alias("first"))
        blocks = blocks.unionByName(
            figure.select(F.lit("model").alias("block"), "first"), allowMissingColumns=True
        )
    return blocks.orderBy(
        "block",
        F.when(F.col("block") == "by_category", F.col("first")).desc_nulls_last(),
        "date",
        "series",
    )
