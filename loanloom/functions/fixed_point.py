"""Sums in whole units of the last decimal place: exact, and so the same in whatever order Spark adds the rows.

A double holds whole numbers up to 2^53 only, which is 9e11 at four places; a total over many rows is larger. So each value is
counted in units, split into a high and a low half, and the halves are added as longs (plain partial aggregation, no
decimals per row). The two sums make one decimal of 38 digits, with which a total is scaled or divided without rounding
before it becomes a double again, once. Sums that do not fit are an overflow error, never a wrong number.

Values beyond 2^62 units (4.6e14 at four places), NaN and infinities have no units. They are added as doubles, beside the
others, as before.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 24
_MOST_UNITS = 2.0 ** 62


def _units(value: Column, places: int) -> tuple[Column, Column]:
    """``value`` in whole units, and whether it has any."""
    units = F.rint(value * 10.0 ** places)
    fits = F.abs(units) < _MOST_UNITS
    return F.when(fits, units).cast("long"), fits


def exact_sum(value: Column, places: int) -> Column:
    """Aggregate: struct of ``units`` (decimal, NULL without values) and ``outside``, the sum of values without units."""
    units, fits = _units(value, places)
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(38,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    return F.struct((high * F.lit(Decimal(1 << _LOW_BITS)) + low).alias("units"),
                    F.sum(F.when(~fits, value)).alias("outside"))


def amount(total: Column, places: int, times: Column | None = None) -> Column:
    """The double nearest to an ``exact_sum``, or to a whole multiple of it; NULL if nothing was added."""
    units, outside = total.getField("units"), total.getField("outside")
    if times is not None:
        units, outside = units * times.cast("decimal(20,0)"), outside * times
    exact = (units * F.lit(Decimal(1).scaleb(-places))).cast("double")
    return F.coalesce(exact + outside, exact, outside)


def exact_mean(value: Column, value_places: int, places: int, percent: bool = False) -> Column:
    """Aggregate: mean of values of ``value_places`` decimals, maybe times 100, rounded half away from zero to ``places``."""
    units = exact_sum(value, value_places).getField("units")
    count = F.count(value)
    dropped = value_places - places - (2 if percent else 0)
    if dropped < 0:
        units, dropped = units * F.lit(Decimal(10 ** -dropped)), 0
    by = F.nullif(count, F.lit(0)).cast("decimal(20,0)") * F.lit(Decimal(10 ** dropped))
    two = F.lit(Decimal(2))
    # |units / by| + 1/2, rounded down: no step rounds before the last one.
    rounded = F.call_function("div", two * F.abs(units) + by, two * by)
    exact = F.signum(units).cast("int") * rounded / 10.0 ** places
    fits = _units(value, value_places)[1]
    rough = F.avg(value) * (100 if percent else 1)
    return F.when(F.count_if(~fits) == 0, exact).otherwise(rough)
