import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanloom.functions import bands, rules
from loanloom.functions.rounding import money, money_sum, money_total, round_half_away, round_half_away_rows, rounded_mean
from loanloom.operators.aggregates import percentage, share_of_total


def apply(spark, function, values, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize("function, kind, cases", [
    (rules.clean_text, "string", {" f ": "F", "xNa": "XNA", "": "", None: None}),
    (rules.null_unless_positive, "double", {1.0: 1.0, 0.0: None, -1.0: None, None: None}),
    (rules.null_if_negative, "double", {1.0: 1.0, 0.0: 0.0, -0.5: None, None: None}),
    (rules.zero_if_null, "double", {None: 0.0, 3.0: 3.0, -1.0: -1.0}),
    (rules.unknown_if_null, "string", {None: "Unknown", "HC": "HC", "": ""}),
    (rules.clamp_at_zero, "int", {-5: 0, 0: 0, 7: 7, None: None}),
    (rules.years_from_days, "int", {-3650: 10.0, 365: 1.0, 0: 0.0, None: None}),
    (rules.years_employed, "int", {365243: None, -730: 2.0, None: None, 0: 0.0}),
    (bands.age_band, "double", {24.99: "Under 25", 25.0: "25-34", 34.0: "25-34", 34.5: "55+", 35.0: "35-44",
                                44.0: "35-44", 44.01: "55+", 45.0: "45-54", 54.0: "45-54", 54.9: "55+", 55.0: "55+",
                                None: "55+"}),
    (bands.employment_band, "double", {None: "Unemployed", 1.99: "Under 2 Years", 2.0: "2-5 Years", 5.0: "2-5 Years",
                                       5.01: "5-10 Years", 10.0: "5-10 Years", 10.01: "10+ Years"}),
    (bands.income_band, "double", {99999.99: "Low (<100K)", 100000.0: "Medium (100-200K)",
                                   200000.0: "Medium (100-200K)", 200000.01: "High (200-500K)",
                                   500000.0: "High (200-500K)", 500000.01: "Very High (500K+)",
                                   None: "Very High (500K+)"}),
    (bands.dti_category, "double", {300.0001: "High DTI", 300.0: "Medium DTI", 150.0: "Medium DTI",
                                    149.9999: "Low DTI", None: "Low DTI"}),
    (bands.default_history, "bigint", {0: "No Previous Defaults", 1: "1 Previous Default", 2: "2 Previous Defaults",
                                       3: "3+ Previous Defaults", 9: "3+ Previous Defaults"}),
])
def test_rule(spark, function, kind, cases):
    assert apply(spark, function, list(cases), kind) == list(cases.values())


def test_flag_is_zero_for_unknown(spark):
    assert apply(spark, lambda v: rules.flag(v > 0), [1.0, 0.0, None]) == [1, 0, 0]


def scaled_half_away(value, places):
    scaled = value * 10.0 ** places
    if abs(scaled) >= 2 ** 52:
        return value
    whole = float(Decimal(abs(scaled)).quantize(Decimal(1), ROUND_HALF_UP))
    return math.copysign(whole, scaled) / 10.0 ** places


def test_ties_go_away_from_zero(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.125, -0.125, 0.4999999999999999, None]
    for function in (round_half_away, round_half_away_rows):
        assert apply(spark, lambda v: function(v, 0), values) == [1.0, -1.0, 2.0, 3.0, -3.0, 0.0, -0.0, 0.0, None]
        assert apply(spark, lambda v: function(v, 2), [0.125, -0.125, 1e15 + 0.125, float("inf")]) == [
            0.13, -0.13, 1e15 + 0.125, float("inf")]


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=200, max_size=300), places=st.integers(0, 4))
def test_rounding_matches_decimal_arithmetic(spark, values, places):
    expected = [scaled_half_away(v, places) for v in values]
    assert apply(spark, lambda v: round_half_away_rows(v, places), values) == expected


def test_rounded_mean_sees_ties(spark):
    # 17.14285 is a tie at four places that a floating-point mean may miss.
    rows = spark.createDataFrame([(20.0,), (14.2857,), (None,)], "v double")
    assert rows.agg(rounded_mean(F.col("v"), 4)).first()[0] == 17.1429
    assert rows.agg(rounded_mean(-F.col("v"), 4)).first()[0] == -17.1429
    assert rows.agg(rounded_mean(F.col("v"), 4, places=2)).first()[0] == 17.14
    assert rows.agg(rounded_mean(F.col("v"), 4, places=2, percent=True)).first()[0] == 1714.29
    assert rows.filter("v IS NULL").agg(rounded_mean(F.col("v"), 4)).first()[0] is None


def test_money_sum_does_not_depend_on_the_split(spark):
    rows = spark.range(10_000).select((F.col("id") * 0.1 + 0.01).alias("v"))
    sums = {rows.repartition(n).agg(money_sum(F.col("v"))).first()[0] for n in (1, 3, 7, 16)}
    assert sums == {4999600.0}


def test_percentage_of_nothing_is_null(spark):
    rows = spark.createDataFrame([(1, 3), (0, 5), (2, 0)], "part int, whole int")
    assert [r[0] for r in rows.select(percentage(F.col("part"), F.col("whole"), 4)).collect()] == [33.3333, 0.0, None]


def test_shares_add_up(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 2), (None, 5)], "g string, n bigint")
    shares = {r.g: r.share for r in share_of_total(groups, "n", "share").collect()}
    assert shares == {"a": 12.5, "b": 25.0, None: 62.5}


def test_money_adds_up_in_any_order(spark):
    """A million amounts of about 1e9 with four places: the exact total, with the same bits in every partitioning."""
    rows = spark.range(1_000_000).select((F.col("id") % 7).alias("g"), (
        F.lit(1e9) + F.col("id") + (F.pmod(F.hash("id"), F.lit(10_000))) / 1e4).alias("x"), F.pmod(F.hash("id"), F.lit(10_000)).alias("u"))
    units = sum((10 ** 9 + i) * 10 ** 4 for i in range(1_000_000)) + rows.agg(F.sum("u")).first()[0]
    totals = set()
    for plan in (rows.repartition(1), rows.repartition(5), rows.repartition(16, "x"), rows.orderBy(F.desc("x"))):
        total = plan.agg(money_sum(F.col("x")), money(money_total(F.col("x")), F.lit(3)), rounded_mean(F.col("x"), 4)).first()
        totals.add(tuple(v.hex() for v in total))
        assert total[0] == units / 10 ** 4 and total[1] == 3 * units / 10 ** 4
        assert total[2] == ((2 * units + 10 ** 6) // (2 * 10 ** 6)) / 10 ** 4
    assert len(totals) == 1
    grouped = rows.groupBy("g").agg(money_sum(F.col("x")).alias("x"))
    assert "HashAggregate" in plan_of(grouped) and "SortAggregate" not in plan_of(grouped)


def test_sums_and_means_of_odd_values(spark):
    def of(*values):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        return tuple(rows.agg(money_sum(F.col("x")), money(money_total(F.col("x"))), rounded_mean(F.col("x"), 4),
                              rounded_mean(F.col("x"), 4, places=2), rounded_mean(F.col("x"), 4, places=2, percent=True)).first())
    assert of() == of(None) == (0.0, None, None, None, None)
    assert of(-0.1, 0.3, None) == (0.2, 0.2, 0.1, 0.1, 10.0)
    assert of(0.005, 0.015) == (0.02, 0.02, 0.01, 0.01, 1.0)
    assert of(0.0049, 0.0051)[3] == 0.01 and of(-0.0049, -0.0051)[3] == -0.01
    assert of(1e300, 1.0)[:2] == (1e300, 1e300) and of(1e300)[2] == 1e300
    assert of(float("inf"), 1.0)[0] == float("inf")
    assert of(float("nan"), 1.0)[0] != of(float("nan"), 1.0)[0]
