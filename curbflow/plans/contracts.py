"""Ten serving contracts of eleven columns each.

Fixed values: metric names, details, statuses and defaults are stated as consumers expect them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from curbflow.functions.naming import present_sql

COLUMNS = (
    "date", "year", "month", "service", "category", "series",
    "metric_name", "metric_value", "metric_aux", "status", "detail",
)


class Field(NamedTuple):
    """Candidate columns, and the default when none of them exists."""

    names: tuple[str, ...]
    default: str = "NULL"


class Contract(NamedTuple):
    table: str
    grain: str  # day, month or period
    dates: tuple[str, ...]
    service: Field
    category: Field
    series: Field
    value: Field
    aux: Field
    metric_name: str
    detail: str
    status: str = "'OK'"


def text(*names: str, default: str) -> Field:
    return Field(names, f"'{default}'")


def number(*names: str) -> Field:
    return Field(names, "0")


SERVICE = text("service", default="all")

CONTRACTS = {
    "D01_Resumen": Contract(
        "daily", "day", ("pickup_date",), SERVICE,
        text("pickup_borough", "pickup_zone", default="NYC"), text("service", default="Total"),
        number("trip_count"), number("total_revenue"),
        "Viajes e ingresos", "Resumen ejecutivo de demanda e ingresos",
    ),
    "D02_Demanda": Contract(
        "hourly", "day", ("pickup_date",), SERVICE,
        text("pickup_hour", default="Sin hora"), text("service", default="Total"),
        number("trip_count"), number("avg_trip_duration_minutes"),
        "Perfil horario de viajes", "Demanda por fecha, hora y servicio",
    ),
    "D03_Ingresos": Contract(
        "finance", "month", (), SERVICE,
        text("payment_type", default="Sin tipo"), text("service", default="Total"),
        number("total_revenue"), number("tip_revenue"),
        "Ingresos y propinas", "Composición financiera por servicio y pago",
    ),
    "D04_Causas": Contract(
        "anomalies", "day", ("pickup_date",), SERVICE,
        text("pickup_borough", "pickup_zone", default="NYC"),
        text("anomaly_direction", default="NORMAL"),
        number("demand_zscore"), number("revenue_zscore"),
        "Desviación de la demanda", "Diagnóstico de cambios frente a la línea base",
        "CASE WHEN {is_anomaly:boolean:false} THEN 'ANOMALÍA' ELSE 'NORMAL' END",
    ),
    "D05_Rutas": Contract(
        "routes", "month", (), SERVICE,
        Field(("route",), "'Origen → Destino'"), text("service", default="Total"),
        number("trip_count"), number("avg_trip_duration_minutes"),
        "Rendimiento de rutas", "Volumen, duración y velocidad por ruta",
        "CASE WHEN {avg_speed_mph:double:99} < 8 THEN 'LENTA' ELSE 'NORMAL' END",
    ),
    "D06_Anomalias": Contract(
        "tips", "month", (), SERVICE,
        text("pickup_borough", default="NYC"), text("payment_type", default="Sin tipo"),
        number("aggregate_tip_rate", "avg_trip_tip_rate"), number("tipped_trip_share"),
        "Factores de propina", "Propensión y tasa de propina por contexto",
    ),
    "D07_Pronostico": Contract(
        "forecast", "day", ("forecast_date", "pickup_date", "ds"),
        text("service", "service_type", default="all"),
        text("service", "service_type", default="Total"), text(default="Pronóstico"),
        number("forecast_trips", "yhat", "prediction"),
        number("forecast_upper_95", "forecast_lower_95"),
        "Viajes pronosticados", "Modelo GBT con calendario y rezagos", "'FORECAST'",
    ),
    "D08_Segmentacion": Contract(
        "segments", "period", (), text("service", "service_type", default="all"),
        text("pickup_zone", "zone_name", "zone_id", default="Zona"),
        text("segment_label", "segment_id", default="Segmento"),
        number("total_trips", "trip_count"), number("revenue_per_trip", "total_revenue"),
        "Segmentación de zonas", "K-Means sobre demanda, ingresos y comportamiento", "'CLUSTER'",
    ),
    "D09_Clasificacion": Contract(
        "classification", "day", ("prediction_date", "pickup_date"),
        text("service", "service_type", default="all"),
        text("zone_name", "pickup_zone", "zone_id", default="Zona"),
        Field(("demand_class",), "'Normal'"),
        number("probability_high_demand"), number("actual_trips", "trip_count"),
        "Probabilidad de alta demanda", "Random Forest con validación temporal",
        "CASE WHEN {actual_high_demand:int:0} = {predicted_high_demand:int:0} "
        "THEN 'ACIERTO' ELSE 'ERROR' END",
    ),
    "D10_Auditoria": Contract(
        "audit", "day", ("timestamp_utc", "started_at", "finished_at"),
        text("service", default="pipeline"), text("event_type", default="evento"),
        text("status", default="UNKNOWN"), Field((), "1.0"),
        number("size_bytes", "source_rows", "silver_rows"),
        "Eventos de auditoría", "Trazabilidad de ejecuciones, archivos, calidad y modelos",
        "{status:string:'UNKNOWN'}",
    ),
}

# Columns some contracts derive from their table before projecting.
DERIVED = {
    "routes": {
        "route": "concat_ws(' → ', {pickup_zone|pickup_borough:string:'Origen'}, "
        "{dropoff_zone|dropoff_borough:string:'Destino'})"
    },
    "classification": {
        "demand_class": "CASE WHEN {predicted_high_demand:int:0} = 1 THEN 'Alta' ELSE 'Normal' END"
    },
}


def _fill(template: str, columns: Sequence[str]) -> str:
    """Replace each ``{names:type:default}`` by tolerant access to the named columns."""
    pieces = template.split("{")
    out = [pieces[0]]
    for piece in pieces[1:]:
        slot, rest = piece.split("}", 1)
        names, dtype, default = slot.split(":")
        out.append(present_sql(columns, names.split("|"), default, dtype) + rest)
    return "".join(out)


def build_contract(rows: DataFrame, name: str) -> DataFrame:
    spec = CONTRACTS[name]
    derived = DERIVED.get(spec.table, {})
    if derived:
        rows = rows.selectExpr(
            "*", *(f"{_fill(sql, rows.columns)} AS {n}" for n, sql in derived.items())
        )
    columns = rows.columns

    def field(item: Field, dtype: str) -> str:
        return present_sql(columns, item.names, item.default, dtype)

    if spec.grain == "day":
        day = present_sql(columns, spec.dates, "NULL", "date")
        date = f"coalesce(date_format({day}, 'yyyy-MM-dd'), 'Sin fecha')"
        own = "pickup_year" in columns and "pickup_month" in columns
        year = "CAST(pickup_year AS int)" if own else f"year({day})"
        month = "CAST(pickup_month AS int)" if own else f"month({day})"
    elif spec.grain == "month":
        year = present_sql(columns, ("pickup_year",), "0", "int")
        month = present_sql(columns, ("pickup_month",), "0", "int")
        known = "pickup_year" in columns and "pickup_month" in columns
        date = f"format_string('%04d-%02d-01', {year}, {month})" if known else "'Sin fecha'"
    else:
        date, year, month = "'Periodo completo'", "0", "0"
    return rows.selectExpr(
        f"{date} AS date",
        f"{year} AS year",
        f"{month} AS month",
        f"coalesce({field(spec.service, 'string')}, 'all') AS service",
        f"coalesce({field(spec.category, 'string')}, 'Sin categoría') AS category",
        f"coalesce({field(spec.series, 'string')}, 'Total') AS series",
        f"'{spec.metric_name}' AS metric_name",
        f"coalesce({field(spec.value, 'double')}, 0D) AS metric_value",
        f"coalesce({field(spec.aux, 'double')}, 0D) AS metric_aux",
        f"coalesce({_fill(spec.status, columns)}, 'OK') AS status",
        f"'{spec.detail}' AS detail",
    )
