"""Reusable measures: aggregates that stay right under any grouping.

Ratios are ratios of sums, never averages of ratios; a zero denominator gives null. Each measure
is SQL text of one aggregate expression over its fact.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Measure(NamedTuple):
    name: str
    label: str  # fixed value: the label reports show
    sql: str


def _over(numerator: str, denominator: str) -> str:
    return f"try_divide({numerator}, {denominator})"


def _metric(name: str) -> str:
    return f"max(metric_value) FILTER (WHERE metric_name = '{name}')"


_HITS = "count_if(actual_high_demand = predicted_high_demand)"

MEASURES: dict[str, tuple[Measure, ...]] = {
    "demand": (
        Measure("trips", "D1 Viajes Totales", "sum(trip_count)"),
        Measure("revenue", "D1 Ingresos Totales", "sum(total_revenue)"),
        Measure(
            "revenue_per_trip", "D1 Ingreso por Viaje", _over("sum(total_revenue)", "sum(trip_count)")
        ),
        Measure(
            "avg_distance", "D1 Distancia Promedio", _over("sum(distance_miles)", "sum(trip_count)")
        ),
    ),
    "hourly": (
        Measure("trips", "D2 Viajes Totales", "sum(trip_count)"),
        Measure(
            "weighted_duration",
            "D2 Duracion Promedio Ponderada",
            _over("sum(duration_minutes)", "sum(trip_count)"),
        ),
        Measure("revenue", "D2 Ingresos Totales", "sum(total_revenue)"),
    ),
    "finance": (
        Measure("revenue", "D3 Ingresos Totales", "sum(total_revenue)"),
        Measure("tips", "D3 Propinas Totales", "sum(tip_revenue)"),
        Measure(
            "tip_rate", "D3 Tasa Propina Ponderada", _over("sum(tip_revenue)", "sum(fare_revenue)")
        ),
        Measure(
            "tipped_share", "D3 Viajes con Propina %", _over("sum(tipped_trips)", "sum(trip_count)")
        ),
    ),
    "anomalies": (
        Measure("anomalies", "D4 Anomalias Detectadas", "count_if(is_anomaly)"),
        Measure("anomaly_share", "D4 Porcentaje Anomalias", _over("count_if(is_anomaly)", "count(1)")),
        Measure("max_abs_zscore", "D4 Puntaje Z Máximo", "max(abs(demand_zscore))"),
    ),
    # The denominator counts the trips of routes whose average is unknown as well.
    "routes": (
        Measure("trips", "D5 Viajes Rutas", "sum(trip_count)"),
        Measure(
            "weighted_duration",
            "D5 Duracion Ponderada",
            _over("sum(avg_trip_duration_minutes * trip_count)", "sum(trip_count)"),
        ),
        Measure(
            "weighted_speed",
            "D5 Velocidad Ponderada",
            _over("sum(avg_speed_mph * trip_count)", "sum(trip_count)"),
        ),
    ),
    "tips": (
        Measure(
            "tip_rate", "D6 Tasa Propina Ponderada", _over("sum(tip_revenue)", "sum(fare_revenue)")
        ),
        Measure(
            "tipped_share", "D6 Viajes con Propina %", _over("sum(tipped_trips)", "sum(trip_count)")
        ),
        Measure("trips", "D6 Viajes Analizados", "sum(trip_count)"),
    ),
    "forecast": (
        Measure("forecast", "D7 Viajes Pronosticados", "sum(forecast_trips)"),
        Measure("lower", "D7 Limite Inferior 95", "sum(forecast_lower_95)"),
        Measure("upper", "D7 Limite Superior 95", "sum(forecast_upper_95)"),
    ),
    "forecast_metrics": (
        Measure("wmape", "D7 Error WMAPE", _over(_metric("wmape_percent"), "100")),
        Measure("rmse", "D7 Error RMSE", _metric("rmse")),
        Measure("r2", "D7 Coeficiente R²", _metric("r2")),
    ),
    "segments": (
        Measure("zones", "D8 Zonas Segmentadas", "count(DISTINCT pickup_location_id)"),
        Measure("trips", "D8 Viajes Segmentados", "sum(total_trips)"),
        Measure(
            "revenue_per_trip",
            "D8 Ingreso por Viaje",
            _over("sum(total_revenue)", "sum(total_trips)"),
        ),
    ),
    "segment_metrics": (
        Measure("silhouette", "D8 Calidad de Segmentos (Silhouette)", _metric("silhouette")),
    ),
    "classification": (
        Measure("cases", "D9 Casos Evaluados", "count(1)"),
        Measure("hits", "D9 Aciertos", _HITS),
        Measure("accuracy", "D9 Exactitud Calculada", _over(_HITS, "count(1)")),
        Measure("mean_probability", "D9 Probabilidad Promedio", "avg(probability_high_demand)"),
    ),
    "classification_metrics": (
        Measure("auc", "D9 Área bajo ROC (AUC)", _metric("auc_roc")),
        Measure("f1", "D9 Puntaje F1", _metric("f1")),
    ),
    "confusion": (Measure("cases", "D9 Matriz Casos", "sum(count)"),),
    "audit": (
        Measure("events", "A10 Eventos", "sum(metric_value)"),
        Measure(
            "events_ok",
            "A10 Eventos OK",
            "sum(metric_value) FILTER (WHERE status IN ('PASSED', 'OK'))",
        ),
    ),
}


def measure(fact: str, name: str) -> str:
    for item in MEASURES[fact]:
        if item.name == name:
            return item.sql
    raise KeyError(f"{fact} has no measure {name}")


def measure_by(fact_rows: DataFrame, fact: str, keys: Sequence[str] = ()) -> DataFrame:
    """All measures of a fact under any grouping."""
    return fact_rows.groupBy(*keys).agg(*(F.expr(m.sql).alias(m.name) for m in MEASURES[fact]))
