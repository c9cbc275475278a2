"""Column rules of the cleaning layer. Each takes the raw column; NULL in gives NULL out unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data set.
UNEMPLOYED_DAYS = 365243
DAYS_PER_YEAR = 365
UNKNOWN = "Unknown"


def clean_text(value: Column) -> Column:
    return F.upper(F.trim(value))


def null_unless_positive(value: Column) -> Column:
    return F.when(value > 0, value)


def null_if_negative(value: Column) -> Column:
    return F.when(value >= 0, value)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def unknown_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNKNOWN))


def clamp_at_zero(value: Column) -> Column:
    # greatest() would skip the NULL and return 0 for it.
    return F.when(value < 0, 0).otherwise(value)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.when(condition, 1).otherwise(0)


def years_from_days(days: Column) -> Column:
    return F.abs(days) / DAYS_PER_YEAR


def years_employed(days: Column) -> Column:
    """Years in the current job; NULL for the unemployed marker and for a missing value."""
    return F.when(days != UNEMPLOYED_DAYS, years_from_days(days))
