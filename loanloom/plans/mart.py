"""Cleaned tables to the star schema.

The row-level tables are always aggregated to the join key first and joined afterwards. Both sides of every join are
then unique on the key: nothing multiplies, and a customer with very many rows is reduced by the map-side aggregation
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.bands import age_band, employment_band, income_band
from loanloom.functions.rounding import money, money_sum, money_total, round_half_away, round_half_away_rows, rounded_mean
from loanloom.operators.aggregates import count_where, max_or_zero, percentage, row_count

MONTHS_PER_YEAR = 12


def customer_columns() -> dict[str, Column]:
    """Columns of ``dim_customer`` over cleaned applications that are computed."""
    return {
        "AGE_BAND": age_band(F.col("AGE_YEARS")),
        "EMPLOYMENT_BAND": employment_band(F.col("YEARS_EMPLOYED")),
        "INCOME_BAND": income_band(F.col("AMT_INCOME_TOTAL")),
    }


def loan_columns() -> dict[str, Column]:
    """Columns of ``dim_loan`` over cleaned applications that are computed. NULL without a positive income."""
    income, credit, annuity = F.col("AMT_INCOME_TOTAL"), F.col("AMT_CREDIT"), F.col("AMT_ANNUITY")

    def against_income(ratio: Column) -> Column:
        return F.when(income > 0, round_half_away_rows(ratio, 4))

    return {
        "DEBT_TO_INCOME_RATIO": against_income(credit / income),
        "DTI_PCT": against_income(credit / income * 100),
        "LOAN_BURDEN_SCORE": against_income(annuity / (income / MONTHS_PER_YEAR)),
    }


# Columns a customer without any matching rows gets 0 in.
PREVIOUS_COUNTS = ("TOTAL_PREV_APPLICATIONS", "PREV_APPROVED", "PREV_REFUSED", "PREV_CANCELED")
CARD_TOTALS = ("BELOW_MIN_PAYMENT_COUNT", "TOTAL_CC_DRAWINGS", "AVG_CC_BALANCE", "MAX_CC_DPD")


def filled(value: int, *names: str) -> list[str]:
    """Select expressions that give ``value`` for NULL."""
    return [f"coalesce({name}, {value}) AS {name}" for name in names]


def previous_summary(previous: DataFrame) -> DataFrame:
    """Counts of previous applications per customer, by outcome."""
    status = F.col("NAME_CONTRACT_STATUS")
    return previous.groupBy(F.col("SK_ID_CURR").alias("CUSTOMER_ID")).agg(
        row_count().alias("TOTAL_PREV_APPLICATIONS"),
        count_where(status == "APPROVED").alias("PREV_APPROVED"),
        count_where(status == "REFUSED").alias("PREV_REFUSED"),
        count_where(status == "CANCELED").alias("PREV_CANCELED"),
    )


def card_summary(card: DataFrame) -> DataFrame:
    """Card behaviour per customer over all card months."""
    balance = F.coalesce(F.col("AMT_BALANCE"), F.lit(0.0))
    return card.groupBy(F.col("SK_ID_CURR").alias("CUSTOMER_ID")).agg(
        rounded_mean(F.col("MONTHLY_CREDIT_UTILIZATION"), 4, places=2, percent=True)
        .alias("AVG_CREDIT_UTILIZATION_PCT"),
        F.sum("IS_BELOW_MIN_PAYMENT").alias("BELOW_MIN_PAYMENT_COUNT"),
        money_sum(F.col("AMT_DRAWINGS_CURRENT")).alias("TOTAL_CC_DRAWINGS"),
        round_half_away(money_sum(balance) / row_count(), 2).alias("AVG_CC_BALANCE"),
        max_or_zero(F.col("SK_DPD_DEF")).alias("MAX_CC_DPD"),
    )


def dim_customer(application: DataFrame) -> DataFrame:
    return application.withColumns(customer_columns()).selectExpr(
        "SK_ID_CURR AS CUSTOMER_ID", "CODE_GENDER AS GENDER", "AGE_YEARS AS AGE", "AGE_BAND",
        "NAME_EDUCATION_TYPE AS EDUCATION", "NAME_FAMILY_STATUS AS FAMILY_STATUS",
        "NAME_HOUSING_TYPE AS HOUSING_TYPE", "CNT_CHILDREN AS NUM_CHILDREN", "CNT_FAM_MEMBERS AS FAMILY_SIZE",
        "OCCUPATION_TYPE AS OCCUPATION", "ORGANIZATION_TYPE AS EMPLOYER_TYPE", "YEARS_EMPLOYED", "EMPLOYMENT_BAND",
        "NAME_INCOME_TYPE AS INCOME_TYPE", "AMT_INCOME_TOTAL AS ANNUAL_INCOME", "INCOME_BAND",
        "REGION_RATING_CLIENT AS REGION_RATING", "TARGET AS DEFAULT_FLAG")


def dim_loan(application: DataFrame, previous: DataFrame) -> DataFrame:
    loans = application.withColumns(loan_columns()).selectExpr(
        "SK_ID_CURR AS CUSTOMER_ID", "NAME_CONTRACT_TYPE AS CONTRACT_TYPE", "AMT_CREDIT AS LOAN_AMOUNT",
        "AMT_ANNUITY AS ANNUAL_REPAYMENT", "AMT_GOODS_PRICE AS GOODS_PRICE", "AMT_INCOME_TOTAL AS ANNUAL_INCOME",
        "DEBT_TO_INCOME_RATIO", "DTI_PCT", "LOAN_BURDEN_SCORE")
    return (loans.join(previous_summary(previous), "CUSTOMER_ID", "left")
            .selectExpr(*loans.columns, *filled(0, *PREVIOUS_COUNTS)))


def dim_credit_history(bureau: DataFrame) -> DataFrame:
    """Bureau record summary for every customer the bureau knows, applicant or not."""
    active = F.col("CREDIT_ACTIVE")
    return bureau.groupBy(F.col("SK_ID_CURR").alias("CUSTOMER_ID")).agg(
        F.count("SK_ID_BUREAU").alias("TOTAL_BUREAU_RECORDS"),
        count_where(active == "ACTIVE").alias("ACTIVE_CREDITS"),
        count_where(active == "CLOSED").alias("CLOSED_CREDITS"),
        money_sum(F.col("AMT_CREDIT_SUM")).alias("TOTAL_CREDIT_SUM"),
        money_sum(F.col("AMT_CREDIT_SUM_DEBT")).alias("TOTAL_DEBT"),
        money_sum(F.col("AMT_CREDIT_SUM_OVERDUE")).alias("TOTAL_OVERDUE"),
        max_or_zero(F.col("AMT_CREDIT_MAX_OVERDUE")).alias("MAX_OVERDUE"),
        F.sum(F.coalesce(F.col("CREDIT_DAY_OVERDUE"), F.lit(0))).alias("TOTAL_DAYS_OVERDUE"),
        count_where(F.col("CREDIT_DAY_OVERDUE") > 0).alias("PREV_DEFAULT_COUNT"),
        F.count_distinct("CREDIT_TYPE").alias("DISTINCT_CREDIT_TYPES"),
        F.max("DAYS_CREDIT_UPDATE").alias("LAST_BUREAU_UPDATE"),
    )


def _loan_activity(installments: DataFrame, pos: DataFrame) -> DataFrame:
    """Totals of both row-level tables per customer and loan, from one aggregation over their union.

    Compared with aggregating each side and joining, this shuffles the partial totals once and sorts nothing.
    """
    late = F.col("DAYS_LATE") > 0
    due = installments.select(
        "SK_ID_CURR", "SK_ID_PREV",
        F.lit(1).alias("due"),
        F.when(F.col("NUM_INSTALMENT_NUMBER").isNotNull(), 1).alias("numbered"),
        F.col("IS_LATE_PAYMENT").alias("late"),
        F.when(late, F.col("DAYS_LATE")).alias("days_late"),
        F.col("AMT_INSTALMENT").alias("scheduled"),
        F.col("AMT_PAYMENT").alias("paid"))
    months = pos.select(
        "SK_ID_CURR", "SK_ID_PREV",
        F.lit(1).alias("month"),
        F.col("SK_DPD_DEF").alias("dpd"),
        F.col("IS_DELINQUENT").alias("delinquent"))
    return (due.unionByName(months, allowMissingColumns=True)
            .groupBy(F.col("SK_ID_CURR").alias("CUSTOMER_ID"), F.col("SK_ID_PREV").alias("PREV_LOAN_ID"))
            .agg(F.count("due").alias("due"),
                 F.count("numbered").alias("numbered"),
                 F.sum("late").alias("late"),
                 F.avg("days_late").alias("mean_days_late"),
                 F.max("days_late").alias("max_days_late"),
                 money_total(F.col("scheduled")).alias("scheduled"),
                 money_total(F.col("paid")).alias("paid"),
                 F.count("month").alias("months"),
                 F.max("dpd").alias("dpd"),
                 F.sum("delinquent").alias("delinquent"))
            .filter(F.col("due") > 0))


def fact_payment_history(installments: DataFrame, pos: DataFrame, inflate: bool = True) -> DataFrame:
    """Payment behaviour per customer and loan, for loans with at least one instalment.

    By definition every instalment of a loan is paired with every POS month of that loan. With ``m`` months and ``n``
    instalments, totals over instalments count ``max(m, 1)`` times and totals over months ``n`` times, while means,
    ratios and maxima are unaffected. The totals are therefore multiplied instead of building the pairs.
    ``inflate=False`` leaves them as they are. A count beyond BIGINT raises an overflow error.
    """
    loans = _loan_activity(installments, pos)
    per_instalment = F.greatest(F.col("months"), F.lit(1)) if inflate else F.lit(1)
    per_month = F.col("due") if inflate else F.lit(1)

    def total(column: str) -> Column:
        return F.coalesce(money(F.col(column), per_instalment), F.lit(0.0))

    totals = loans.select(
        "CUSTOMER_ID", "PREV_LOAN_ID",
        (F.col("numbered") * per_instalment).alias("TOTAL_INSTALLMENTS"),
        (F.col("late") * per_instalment).alias("LATE_PAYMENTS"),
        percentage(F.col("late"), F.col("due"), 4, round_half_away_rows).alias("MISSED_PAYMENT_RATIO"),
        round_half_away_rows(F.col("mean_days_late"), 2).alias("AVG_DAYS_LATE"),
        F.col("max_days_late").alias("MAX_DAYS_LATE"),
        total("scheduled").alias("TOTAL_SCHEDULED"),
        total("paid").alias("TOTAL_PAID"),
        F.coalesce(F.col("dpd"), F.lit(0)).alias("MAX_DPD"),
        (F.coalesce(F.col("delinquent"), F.lit(0)) * per_month).alias("DELINQUENT_MONTHS"))
    return totals.select(
        "CUSTOMER_ID", "PREV_LOAN_ID", "TOTAL_INSTALLMENTS", "LATE_PAYMENTS", "MISSED_PAYMENT_RATIO", "AVG_DAYS_LATE",
        "MAX_DAYS_LATE", "TOTAL_SCHEDULED", "TOTAL_PAID",
        percentage(F.col("TOTAL_PAID"), F.col("TOTAL_SCHEDULED"), 4, round_half_away_rows).alias("PAYMENT_RATIO_PCT"),
        "MAX_DPD", "DELINQUENT_MONTHS")


def fact_loan_performance(application: DataFrame, card: DataFrame) -> DataFrame:
    """Default outcome and card behaviour per customer. Without a card the mean utilisation is NULL, the rest 0."""
    outcome = application.selectExpr(
        "SK_ID_CURR AS CUSTOMER_ID", "TARGET AS DEFAULT_FLAG", "AMT_CREDIT AS LOAN_AMOUNT",
        "AMT_INCOME_TOTAL AS ANNUAL_INCOME", "AMT_ANNUITY AS ANNUAL_REPAYMENT")
    return (outcome.join(card_summary(card), "CUSTOMER_ID", "left")
            .selectExpr(*outcome.columns, "AVG_CREDIT_UTILIZATION_PCT", *filled(0, *CARD_TOTALS)))
