"""Rule-based risk score.

The rules are a table; each rule becomes one points column, the points are added once, and category and exposure are
read off the sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def above(bound: float) -> Test:
    return lambda value: value > bound


def at_least(bound: float) -> Test:
    return lambda value: value >= bound


def below(bound: float) -> Test:
    return lambda value: value < bound


def between(low: float, high: float) -> Test:
    return lambda value: value.between(low, high)


def equal(bound: float) -> Test:
    return lambda value: value == bound


def missing(value: Column) -> Column:
    return value.isNull()


@dataclass(frozen=True)
class Rule:
    """Points by the first tier that matches ``feature``; 0 if none does, also for NULL."""

    points: str
    feature: str
    tiers: tuple[tuple[Test, int], ...]

    def column(self) -> Column:
        value = F.col(self.feature)
        cases = F
        for test, points in self.tiers:
            cases = cases.when(test(value), points)
        return cases.otherwise(0)


# Thresholds and points of the risk model.
RULES = (
    Rule("PTS_DTI", "DTI_PCT", ((above(300), 30), (between(150, 300), 15))),
    Rule("PTS_PREV_DEFAULT", "PREV_DEFAULT_COUNT", ((at_least(1), 25),)),
    Rule("PTS_EMPLOYMENT", "YEARS_EMPLOYED", ((missing, 20), (below(2), 20))),
    Rule("PTS_UTILIZATION", "AVG_CREDIT_UTILIZATION_PCT", ((above(80), 15), (between(50, 80), 8))),
    Rule("PTS_MISSED_PAYMENTS", "MISSED_PAYMENT_RATIO", ((above(20), 10), (between(10, 20), 5))),
    Rule("PTS_REFUSALS", "PREV_REFUSED", ((at_least(2), 10), (equal(1), 5))),
    Rule("PTS_MAX_DPD", "MAX_DPD", ((above(90), 10), (between(30, 90), 5))),
    Rule("PTS_DELINQUENCY", "DELINQUENT_MONTHS", ((above(5), 5),)),
)
HIGH_RISK, MEDIUM_RISK, LOW_RISK = "High Risk", "Medium Risk", "Low Risk"
HIGH_FROM, MEDIUM_FROM = 61, 31

_FEATURES_KEPT = (
    "CUSTOMER_ID", "GENDER", "AGE", "AGE_BAND", "EDUCATION", "FAMILY_STATUS", "HOUSING_TYPE", "OCCUPATION",
    "INCOME_TYPE", "ANNUAL_INCOME", "INCOME_BAND", "YEARS_EMPLOYED", "EMPLOYMENT_BAND", "REGION_RATING",
    "DEFAULT_FLAG", "LOAN_AMOUNT", "DTI_PCT", "DTI_CATEGORY", "LOAN_BURDEN_SCORE", "PREV_DEFAULT_COUNT",
    "MISSED_PAYMENT_RATIO", "AVG_CREDIT_UTILIZATION_PCT", "AVG_DAYS_LATE", "MAX_DPD", "DELINQUENT_MONTHS",
    "PREV_REFUSED", "TOTAL_PREV_APPLICATIONS", "PAYMENT_RATIO_PCT", "TOTAL_DEBT", "TOTAL_OVERDUE",
)


def with_points(features: DataFrame) -> DataFrame:
    return features.withColumns({rule.points: rule.column() for rule in RULES})


def risk_points(features: DataFrame) -> DataFrame:
    """Points of each rule per customer."""
    return with_points(features).select("CUSTOMER_ID", *[rule.points for rule in RULES])


def risk_category(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, HIGH_RISK).when(score >= MEDIUM_FROM, MEDIUM_RISK).otherwise(LOW_RISK)


def customer_risk_scores(features: DataFrame) -> DataFrame:
    """Score, category and the loan amount at risk, which counts for high-risk customers only."""
    score = F.col("RISK_SCORE")
    total = " + ".join(rule.points for rule in RULES)
    return (with_points(features)
            .selectExpr(*_FEATURES_KEPT, f"{total} AS RISK_SCORE")
            .withColumns({
                "RISK_CATEGORY": risk_category(score),
                "HIGH_RISK_EXPOSURE": F.when(score >= HIGH_FROM, F.col("LOAN_AMOUNT")).otherwise(0.0),
            }))
