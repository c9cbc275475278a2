"""What stored tables are expected to hold, checked on metrics that are observed while they are written.

Metrics are plain aggregates: they cost no scan of their own. Some expectations hold for any portfolio (no negative amount, one
row per customer, as many rows as the table it was made of). Others are the figures of the published data set; a load
of exactly that data can ask for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom.functions.rounding import rounded_mean
from loanloom.sources.layers import ANALYTICS, CLEANED, RAW, Layers, Metrics
from loanloom.sources.schemas import APPLICATION, BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS, RAW_TABLES

Table = tuple[str, str]


class ExpectationError(ValueError):
    """A table was not replaced because a metric of its new rows is not what is expected."""


@dataclass(frozen=True)
class Range:
    """``metric`` of ``table`` lies between two values, ends included. A metric without a value (NULL) passes, as a minimum
    over no rows does."""

    table: Table
    metric: str
    least: float | None = None
    most: float | None = None

    def check(self, metrics: Metrics, layers: Layers) -> None:
        value = metrics[self.metric]
        if value is None or (self.least is None or value >= self.least) and (self.most is None or value <= self.most):
            return
        wanted = f"{self.least}" if self.least == self.most else f"{self.least} to {self.most}"
        raise ExpectationError(f"{'.'.join(self.table)}: {self.metric} is {value}, expected {wanted}")


@dataclass(frozen=True)
class Rows:
    """``table`` has as many rows as ``other`` has stored, or, if ``fewer`` is set, at most as many."""

    table: Table
    other: Table
    fewer: bool = False

    def check(self, metrics: Metrics, layers: Layers) -> None:
        most = layers.metrics(*self.other).get("row_count")
        if most is not None:
            Range(self.table, "row_count", None if self.fewer else most, most).check(metrics, layers)


Expectation = Range | Rows


def _percent(flag: str) -> Column:
    return F.avg(flag) * 100


# Observed beside the row count.
METRICS: dict[Table, dict[str, Column | Callable[[], Column]]] = {
    (CLEANED, BUREAU): {"min_credit_sum": lambda: F.min("AMT_CREDIT_SUM"), "min_debt": lambda: F.min("AMT_CREDIT_SUM_DEBT"),
                        "min_overdue": lambda: F.min("AMT_CREDIT_MAX_OVERDUE")},
    (CLEANED, INSTALLMENTS): {"late_payment_pct": lambda: _percent("IS_LATE_PAYMENT")},
    (CLEANED, POS): {"delinquency_rate_pct": lambda: _percent("IS_DELINQUENT")},
    (CLEANED, CARD): {"below_min_pct": lambda: _percent("IS_BELOW_MIN_PAYMENT"),
                      "avg_utilization_pct": lambda: rounded_mean(F.col("MONTHLY_CREDIT_UTILIZATION"), 4, places=2, percent=True)},
    (ANALYTICS, "dim_credit_history"): {"avg_bureau_records": lambda: F.avg("TOTAL_BUREAU_RECORDS"),
                                        "max_prev_defaults": lambda: F.max("PREV_DEFAULT_COUNT")},
    (ANALYTICS, "fact_payment_history"): {"avg_missed_pct": lambda: rounded_mean(F.col("MISSED_PAYMENT_RATIO"), 4, places=2),
                                          "avg_payment_ratio": lambda: rounded_mean(F.col("PAYMENT_RATIO_PCT"), 4, places=2)},
    (ANALYTICS, "customer_risk_scores"): {"default_rate_pct": lambda: _percent("DEFAULT_FLAG"),
                                          "min_score": lambda: F.min("RISK_SCORE"), "max_score": lambda: F.max("RISK_SCORE")},
}


def metrics_of(layer: str, table: str) -> dict[str, Column]:
    return {name: column() for name, column in METRICS.get((layer, table), {}).items()}


_PER_CUSTOMER = ("dim_customer", "dim_loan", "fact_loan_performance", "customer_risk_features", "customer_risk_scores")

# Hold for any portfolio.
GENERAL: tuple[Expectation, ...] = (
    *[Rows((CLEANED, table), (RAW, table), fewer=True) for table in RAW_TABLES],
    *[Range((CLEANED, BUREAU), metric, least=0) for metric in ("min_credit_sum", "min_debt", "min_overdue")],
    *[Rows((ANALYTICS, table), (CLEANED, APPLICATION)) for table in _PER_CUSTOMER],
    Rows((ANALYTICS, "dim_credit_history"), (CLEANED, BUREAU), fewer=True),
    Rows((ANALYTICS, "fact_payment_history"), (CLEANED, INSTALLMENTS), fewer=True),
    *[Range(table, metric, 0, 0) for table in ((CLEANED, APPLICATION), (ANALYTICS, "dim_credit_history"),
                                               *[(ANALYTICS, t) for t in _PER_CUSTOMER])
      for metric in ("repeated_keys", "missing_keys")],
    Range((ANALYTICS, "customer_risk_scores"), "min_score", least=0),
)


def _about(table: Table, metric: str, value: float, within: float = 0.005) -> Range:
    return Range(table, metric, round(value - within, 4), round(value + within, 4))


# Row counts and rates of the published data set.
_ROWS = {
    (RAW, APPLICATION): 307_511, (RAW, BUREAU): 1_716_428, (RAW, PREVIOUS): 1_670_214, (RAW, INSTALLMENTS): 13_605_401,
    (RAW, POS): 10_001_358, (RAW, CARD): 3_840_312, (CLEANED, APPLICATION): 307_511,
    (ANALYTICS, "dim_customer"): 307_511, (ANALYTICS, "dim_loan"): 307_511, (ANALYTICS, "dim_credit_history"): 305_811,
    (ANALYTICS, "fact_payment_history"): 997_752, (ANALYTICS, "customer_risk_features"): 307_511,
    (ANALYTICS, "customer_risk_scores"): 307_511,
}
PUBLISHED: tuple[Expectation, ...] = (
    *[Range(table, "row_count", rows, rows) for table, rows in _ROWS.items()],
    _about((CLEANED, INSTALLMENTS), "late_payment_pct", 8.43),
    _about((CLEANED, POS), "delinquency_rate_pct", 2.95),
    _about((CLEANED, CARD), "below_min_pct", 5.58),
    _about((CLEANED, CARD), "avg_utilization_pct", 37.47),
    _about((ANALYTICS, "dim_credit_history"), "avg_bureau_records", 5.61),
    Range((ANALYTICS, "dim_credit_history"), "max_prev_defaults", 7, 7),
    _about((ANALYTICS, "fact_payment_history"), "avg_missed_pct", 6.91),
    _about((ANALYTICS, "fact_payment_history"), "avg_payment_ratio", 98.71),
    _about((ANALYTICS, "customer_risk_scores"), "default_rate_pct", 8.07),
)


def checker(layers: Layers, layer: str, table: str, expectations: tuple[Expectation, ...]) -> Callable[[Metrics], None]:
    """Raises on the first of the table's expectations that its metrics do not meet."""
    own = [expectation for expectation in expectations if expectation.table == (layer, table)]

    def check(metrics: Metrics) -> None:
        for expectation in own:
            expectation.check(metrics, layers)

    return check
