"""Rounding that is the same on every run, however Spark splits the rows.

All of it scales, rounds half away from zero to a whole number and scales back, the way databases round floating-point
numbers. (``round(x, 4)`` would round the decimal text of the double instead and settle ties differently.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom.functions.fixed_point import amount, exact_mean, exact_sum

# Decimals an amount of money carries at most.
MONEY_PLACES = 4


def round_half_away(value: Column, places: int) -> Column:
    """``value`` to ``places`` decimals, ties away from zero."""
    scale = 10.0 ** places
    return F.round(value * scale, 0) / scale


def round_half_away_rows(value: Column, places: int) -> Column:
    """The same result for rows and loans, of which there are many: about twenty times cheaper per value.

    Built-in ``round`` on a double goes through a decimal string; this stays in double arithmetic. It repeats ``value``,
    so pass a column or a short expression and no aggregate. A double beyond 2^52 units of the last place has no digits
    left to round and is returned as it is.
    """
    scale = 10.0 ** places
    rounded = F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale
    return F.when(F.abs(value) < 2.0 ** 52 / scale, rounded).otherwise(value)


def rounded_mean(value: Column, value_places: int, places: int | None = None, percent: bool = False) -> Column:
    """Mean of values that have ``value_places`` decimals, to ``places`` decimals (default: as many), maybe times 100.

    The values are added as whole units of their last place, so the mean does not depend on the order of the rows, and
    a tie is seen as a tie.
    """
    return exact_mean(value, value_places, value_places if places is None else places, percent)


def money_total(value: Column) -> Column:
    """Exact sum of amounts, to be scaled before ``money`` turns it into a double."""
    return exact_sum(value, MONEY_PLACES)


def money(total: Column, times: Column | None = None) -> Column:
    """A ``money_total``, or a whole multiple of it, as a double; NULL if no amount was added."""
    return amount(total, MONEY_PLACES, times)


def money_sum(value: Column) -> Column:
    """Sum of amounts, 0 without any, exact to four places whatever the order of the rows."""
    return F.coalesce(money(money_total(value)), F.lit(0.0))
