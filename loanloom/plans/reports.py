"""Quality checks and portfolio reports. Every report aggregates on the cluster and returns a few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.bands import default_history
from loanloom.functions.rounding import money, money_total, round_half_away, rounded_mean
from loanloom.operators.aggregates import mean_percentage, percentage, row_count, share_of_total
from loanloom.plans.scoring import HIGH_RISK, MEDIUM_RISK

TOP_CUSTOMERS = 50
MILLION = 1e6


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One labelled row count per table."""
    counts = [rows.agg(row_count().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def _flag_rate(rows: DataFrame, flag: str, hits: str, total: str, rate: str) -> DataFrame:
    return (rows.agg(F.sum(flag).alias(hits), row_count().alias(total))
            .withColumn(rate, percentage(F.col(hits), F.col(total))))


# --- cleaned layer ---------------------------------------------------------------------------------------------------

def bureau_minima(bureau: DataFrame) -> DataFrame:
    """No cleaned amount may be negative."""
    return bureau.agg(F.min("AMT_CREDIT_SUM").alias("min_credit_sum"),
                      F.min("AMT_CREDIT_SUM_DEBT").alias("min_debt"),
                      F.min("AMT_CREDIT_MAX_OVERDUE").alias("min_overdue"))


def status_distribution(previous: DataFrame) -> DataFrame:
    groups = previous.groupBy("NAME_CONTRACT_STATUS").agg(row_count().alias("count"))
    return share_of_total(groups, "count", "percentage").orderBy(F.desc("count"), "NAME_CONTRACT_STATUS")


def late_payment_rate(installments: DataFrame) -> DataFrame:
    return _flag_rate(installments, "IS_LATE_PAYMENT", "late_payments", "total_payments", "late_payment_pct")


def delinquency_rate(pos: DataFrame) -> DataFrame:
    return _flag_rate(pos, "IS_DELINQUENT", "delinquent_months", "total_months", "delinquency_rate_pct")


def card_metrics(card: DataFrame) -> DataFrame:
    totals = card.agg(
        F.sum("IS_BELOW_MIN_PAYMENT").alias("below_min_count"),
        row_count().alias("total_records"),
        rounded_mean(F.col("MONTHLY_CREDIT_UTILIZATION"), 4, places=2, percent=True).alias("avg_utilization_pct"))
    return totals.select("below_min_count", "total_records",
                         percentage(F.col("below_min_count"), F.col("total_records")).alias("below_min_pct"),
                         "avg_utilization_pct")


# --- star schema -----------------------------------------------------------------------------------------------------

def credit_history_stats(credit_history: DataFrame) -> DataFrame:
    return credit_history.agg(
        round_half_away(F.avg("TOTAL_BUREAU_RECORDS"), 2).alias("avg_bureau_records"),
        round_half_away(F.avg("PREV_DEFAULT_COUNT"), 2).alias("avg_prev_defaults"),
        F.max("PREV_DEFAULT_COUNT").alias("max_prev_defaults"))


def payment_stats(payments: DataFrame) -> DataFrame:
    return payments.agg(
        rounded_mean(F.col("MISSED_PAYMENT_RATIO"), 4, places=2).alias("avg_missed_pct"),
        rounded_mean(F.col("PAYMENT_RATIO_PCT"), 4, places=2).alias("avg_payment_ratio"),
        F.max("MAX_DPD").alias("worst_dpd_ever"),
        round_half_away(F.avg("MAX_DAYS_LATE"), 2).alias("avg_max_days_late"))


def default_distribution(performance: DataFrame) -> DataFrame:
    groups = performance.groupBy("DEFAULT_FLAG").agg(row_count().alias("customers"))
    return share_of_total(groups, "customers", "pct").orderBy("DEFAULT_FLAG")


# --- features --------------------------------------------------------------------------------------------------------

def feature_means(features: DataFrame) -> DataFrame:
    return features.agg(
        rounded_mean(F.col("DTI_PCT"), 4, places=2).alias("avg_dti"),
        rounded_mean(F.col("LOAN_BURDEN_SCORE"), 4).alias("avg_burden"),
        round_half_away(F.avg("PREV_DEFAULT_COUNT"), 4).alias("avg_prev_defaults"),
        rounded_mean(F.col("MISSED_PAYMENT_RATIO"), 4).alias("avg_missed_pmt"),
        rounded_mean(F.col("AVG_CREDIT_UTILIZATION_PCT"), 2).alias("avg_utilization"),
        round_half_away(F.avg("YEARS_EMPLOYED"), 2).alias("avg_years_employed"))


def _default_rate_by(rows: DataFrame, group: str, *more: Column) -> DataFrame:
    """Customers and default rate per group, riskiest group first."""
    return (rows.groupBy(group)
            .agg(row_count().alias("customers"),
                 mean_percentage(F.col("DEFAULT_FLAG")).alias("default_rate_pct"),
                 *more)
            .orderBy(F.desc_nulls_first("default_rate_pct"), group))


def default_by_dti(features: DataFrame) -> DataFrame:
    return _default_rate_by(features, "DTI_CATEGORY")


def default_by_employment(features: DataFrame) -> DataFrame:
    return _default_rate_by(features, "EMPLOYMENT_BAND")


def default_by_history(features: DataFrame) -> DataFrame:
    history = default_history(F.col("PREV_DEFAULT_COUNT")).alias("default_history")
    return _default_rate_by(features.select(history, "DEFAULT_FLAG"), "default_history")


# --- scores ----------------------------------------------------------------------------------------------------------

def _mean_score() -> Column:
    return round_half_away(F.avg("RISK_SCORE"), 2).alias("avg_risk_score")


def _exposure() -> Column:
    """Loan amounts in millions, from an exact sum."""
    return money(money_total(F.col("LOAN_AMOUNT"))) / MILLION


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Size, exposure, mean score and defaults of each risk category, highest risk first."""
    category = F.col("RISK_CATEGORY")
    groups = scores.groupBy(category).agg(
        row_count().alias("customers"),
        round_half_away(_exposure(), 2).alias("exposure_millions"),
        _mean_score(),
        F.sum("DEFAULT_FLAG").alias("actual_defaults_caught"))
    return (share_of_total(groups, "customers", "pct_of_portfolio")
            .select("RISK_CATEGORY", "customers", "pct_of_portfolio", "exposure_millions", "avg_risk_score",
                    "actual_defaults_caught",
                    percentage(F.col("actual_defaults_caught"), F.col("customers")).alias("default_rate_in_segment"))
            .orderBy(F.when(category == HIGH_RISK, 1).when(category == MEDIUM_RISK, 2).otherwise(3)))


def portfolio_default_rate(scores: DataFrame) -> DataFrame:
    return scores.agg(mean_percentage(F.col("DEFAULT_FLAG")).alias("portfolio_default_rate_pct"))


def risk_concentration(scores: DataFrame) -> DataFrame:
    """Exposure and expected loss of each risk category, largest exposure first."""
    exposure, rate = _exposure(), F.avg("DEFAULT_FLAG")
    return (scores.groupBy("RISK_CATEGORY")
            .agg(row_count().alias("customers"),
                 round_half_away(exposure, 2).alias("total_exposure_millions"),
                 mean_percentage(F.col("DEFAULT_FLAG")).alias("default_rate_pct"),
                 round_half_away(exposure * rate, 2).alias("expected_loss_millions"))
            .orderBy(F.desc_nulls_first("total_exposure_millions"), "RISK_CATEGORY"))


def risk_by_age(scores: DataFrame) -> DataFrame:
    return _default_rate_by(scores, "AGE_BAND", _mean_score())


def risk_by_income(scores: DataFrame) -> DataFrame:
    return _default_rate_by(scores, "INCOME_BAND")


def risk_by_employment(scores: DataFrame) -> DataFrame:
    return _default_rate_by(scores, "EMPLOYMENT_BAND", _mean_score())


def top_high_risk(scores: DataFrame, limit: int = TOP_CUSTOMERS) -> DataFrame:
    """The high-risk customers with the highest scores; equal scores in order of the customer id."""
    return (scores.filter(F.col("RISK_CATEGORY") == HIGH_RISK)
            .select("CUSTOMER_ID", "RISK_SCORE", "RISK_CATEGORY", "LOAN_AMOUNT", "DTI_PCT", "PREV_DEFAULT_COUNT",
                    "MISSED_PAYMENT_RATIO", "AVG_CREDIT_UTILIZATION_PCT", "YEARS_EMPLOYED", "DEFAULT_FLAG")
            .orderBy(F.desc("RISK_SCORE"), "CUSTOMER_ID")
            .limit(limit))
