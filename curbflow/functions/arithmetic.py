"""Null-aware sums and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def sum_or_zero(column: Column) -> Column:
    """Sum in which a group of nulls counts as 0 (its average stays null)."""
    return F.sum(zero_if_null(column))


def ratio_if_positive(numerator: Column, denominator: Column) -> Column:
    """Quotient, null unless the denominator is above zero."""
    return F.when(denominator > 0, numerator / denominator)


def count_where(condition: Column) -> Column:
    """Rows meeting the condition, as a sum so that an empty match is 0 in every group."""
    return F.sum(F.when(condition, 1).otherwise(0))
