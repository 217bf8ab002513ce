"""Conformed dimensions of the star schema.

Fixed values: labels are stated as the reports show them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONTH_NAMES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
WEEKDAY_NAMES = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")
SERVICE_LABELS = {
    "yellow": "Yellow Taxi",
    "green": "Green Taxi",
    "fhv": "For-Hire Vehicle",
    "fhvhv": "High Volume FHV",
}
PAYMENT_LABELS = {
    1: "Tarjeta",
    2: "Efectivo",
    3: "Sin cargo",
    4: "Disputa",
    5: "Desconocido",
    6: "Viaje anulado",
}


def _texts(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def date_dimension(
    spark: SparkSession, first: str = "2023-01-01", last: str = "2026-12-31"
) -> DataFrame:
    """One row per day; weekday 1 is Monday."""
    days = spark.range(1).selectExpr(f"explode(sequence(DATE'{first}', DATE'{last}')) AS date")
    return days.selectExpr(
        "date",
        "year(date) AS year",
        "month(date) AS month_number",
        f"element_at({_texts(MONTH_NAMES)}, month(date)) AS month_name",
        "concat('T', quarter(date)) AS quarter",
        "date_format(date, 'yyyy-MM') AS year_month",
        "year(date) * 100 + month(date) AS year_month_order",
        "weekday(date) + 1 AS weekday_number",
        f"element_at({_texts(WEEKDAY_NAMES)}, weekday(date) + 1) AS weekday_name",
        "weekday(date) >= 5 AS is_weekend",
    )


def _members(spark: SparkSession, labels: dict, key: str, name: str) -> DataFrame:
    """Inline rows: Catalyst knows their size, so facts are never shuffled to meet them."""
    rows = ", ".join(f"({k!r}, {v!r})" for k, v in labels.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS members({key}, {name})")


def service_dimension(spark: SparkSession) -> DataFrame:
    return _members(spark, SERVICE_LABELS, "service", "service_name")


def payment_dimension(spark: SparkSession) -> DataFrame:
    return _members(spark, PAYMENT_LABELS, "payment_type", "payment_name")


def hour_dimension(spark: SparkSession) -> DataFrame:
    return spark.range(24).selectExpr(
        "CAST(id AS int) AS hour",
        "CASE WHEN id < 6 THEN 'Madrugada' WHEN id < 12 THEN 'Mañana' "
        "WHEN id < 18 THEN 'Tarde' ELSE 'Noche' END AS hour_band",
        "id BETWEEN 7 AND 9 OR id BETWEEN 16 AND 19 AS is_rush_hour",
    )


def cluster_dimension(segments: DataFrame) -> DataFrame:
    """One row per cluster that the segmentation produced."""
    return (
        segments.select("segment_id")
        .distinct()
        .selectExpr("segment_id", "concat('Segmento ', segment_id) AS segment_name")
    )
