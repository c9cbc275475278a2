"""Aggregate expressions shared by the marts and the reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.rounding import round_half_away


def row_count() -> Column:
    return F.count(F.lit(1))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def max_or_zero(value: Column) -> Column:
    """Largest value with NULL read as 0."""
    return F.max(F.coalesce(value, F.lit(0)))


def percentage(part: Column, whole: Column, places: int = 2,
               rounding: Callable[[Column, int], Column] = round_half_away) -> Column:
    """``part`` in percent of ``whole``; NULL where ``whole`` is 0 or NULL."""
    return rounding(part * 100.0 / F.nullif(whole, F.lit(0)), places)


def mean_percentage(flag: Column, places: int = 2) -> Column:
    """Share of rows with a 0/1 flag set, in percent."""
    return round_half_away(F.avg(flag) * 100.0, places)


def share_of_total(groups: DataFrame, count: str, share: str, places: int = 2) -> DataFrame:
    """Add each group's percentage of all groups.

    ``groups`` is an aggregated result with one row per category; only those few rows pass through the window.
    """
    total = F.sum(count).over(Window.partitionBy())
    return groups.withColumn(share, percentage(F.col(count), total, places))
