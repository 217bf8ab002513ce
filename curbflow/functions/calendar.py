"""Calendar columns and slot flags of a pickup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(moment: str = "pickup_datetime") -> dict[str, Column]:
    """Date, year, month, weekday (1 = Sunday) and hour of the pickup."""
    return {
        "pickup_date": F.to_date(moment),
        "pickup_year": F.year(moment),
        "pickup_month": F.month(moment),
        "pickup_day_of_week": F.dayofweek(moment),
        "pickup_hour": F.hour(moment),
    }


def is_night(hour: Column) -> Column:
    return hour.between(0, 5)


def is_rush(hour: Column) -> Column:
    return hour.between(7, 9) | hour.between(16, 19)


def is_weekend(day_of_week: Column) -> Column:
    """``day_of_week`` as Spark counts it, 1 = Sunday and 7 = Saturday."""
    return day_of_week.isin(1, 7)


def month_start(year: Column, month: Column) -> Column:
    """First day of the month, null when year or month is not a calendar one."""
    usable = year.between(1, 9999) & month.between(1, 12)
    return F.when(usable, F.make_date(year, month, F.lit(1)))
