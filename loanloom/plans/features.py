"""One row of risk features per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.bands import dti_category
from loanloom.functions.rounding import rounded_mean
from loanloom.plans.mart import PREVIOUS_COUNTS, card_summary, customer_columns, filled, loan_columns, previous_summary

# Output columns in order. A customer without bureau, payment or card history gets 0 there, and a payment ratio of 100.
_FEATURES = [
    "CUSTOMER_ID", "GENDER", "AGE", "AGE_BAND", "EDUCATION", "FAMILY_STATUS", "HOUSING_TYPE", "OCCUPATION",
    "EMPLOYER_TYPE", "INCOME_TYPE", "ANNUAL_INCOME", "INCOME_BAND", "REGION_RATING", "DEFAULT_FLAG",
    "DTI_PCT", "DTI_CATEGORY", "LOAN_BURDEN_SCORE", "LOAN_AMOUNT", "ANNUAL_REPAYMENT",
    *filled(0, *PREVIOUS_COUNTS),
    *filled(0, "TOTAL_BUREAU_RECORDS", "ACTIVE_CREDITS", "CLOSED_CREDITS", "TOTAL_DEBT", "TOTAL_OVERDUE",
            "MAX_OVERDUE", "TOTAL_DAYS_OVERDUE", "PREV_DEFAULT_COUNT"),
    *filled(0, "MISSED_PAYMENT_RATIO", "AVG_DAYS_LATE", "MAX_DAYS_LATE", "MAX_DPD", "DELINQUENT_MONTHS"),
    *filled(100, "PAYMENT_RATIO_PCT"),
    *filled(0, "AVG_CREDIT_UTILIZATION_PCT", "BELOW_MIN_PAYMENT_COUNT", "MAX_CC_DPD", "AVG_CC_BALANCE"),
    "YEARS_EMPLOYED", "EMPLOYMENT_BAND",
]


def payment_by_customer(payments: DataFrame) -> DataFrame:
    """Payment behaviour per customer: plain means over the customer's loans, worst cases and totals."""
    return payments.groupBy("CUSTOMER_ID").agg(
        rounded_mean(F.col("MISSED_PAYMENT_RATIO"), 4).alias("MISSED_PAYMENT_RATIO"),
        rounded_mean(F.col("AVG_DAYS_LATE"), 2).alias("AVG_DAYS_LATE"),
        F.max("MAX_DAYS_LATE").alias("MAX_DAYS_LATE"),
        F.max("MAX_DPD").alias("MAX_DPD"),
        F.sum("DELINQUENT_MONTHS").alias("DELINQUENT_MONTHS"),
        rounded_mean(F.col("PAYMENT_RATIO_PCT"), 4).alias("PAYMENT_RATIO_PCT"),
    )


def customer_risk_features(application: DataFrame, previous: DataFrame, credit_history: DataFrame,
                           payments: DataFrame, card: DataFrame) -> DataFrame:
    """Features straight from cleaned applications, previous applications and card months, plus the bureau dimension
    and the payment fact.

    ``dim_customer``, ``dim_loan`` and ``fact_loan_performance`` all start from the same application rows, so here
    those rows are read and deduplicated once and get the aggregated sides joined on. All joins share the customer
    key and its partitioning.
    """
    customers = application.withColumns({**customer_columns(), **loan_columns()}).selectExpr(
        "SK_ID_CURR AS CUSTOMER_ID", "CODE_GENDER AS GENDER", "AGE_YEARS AS AGE", "AGE_BAND",
        "NAME_EDUCATION_TYPE AS EDUCATION", "NAME_FAMILY_STATUS AS FAMILY_STATUS",
        "NAME_HOUSING_TYPE AS HOUSING_TYPE", "OCCUPATION_TYPE AS OCCUPATION", "ORGANIZATION_TYPE AS EMPLOYER_TYPE",
        "NAME_INCOME_TYPE AS INCOME_TYPE", "AMT_INCOME_TOTAL AS ANNUAL_INCOME", "INCOME_BAND",
        "REGION_RATING_CLIENT AS REGION_RATING", "TARGET AS DEFAULT_FLAG", "DTI_PCT", "LOAN_BURDEN_SCORE",
        "AMT_CREDIT AS LOAN_AMOUNT", "AMT_ANNUITY AS ANNUAL_REPAYMENT", "YEARS_EMPLOYED", "EMPLOYMENT_BAND")
    return _joined(customers, previous_summary(previous), credit_history, payment_by_customer(payments),
                   card_summary(card))


def features_from_star(customers: DataFrame, loans: DataFrame, credit_history: DataFrame, payments: DataFrame,
                       performance: DataFrame) -> DataFrame:
    """The same features from the five stored star-schema tables."""
    return _joined(
        customers, loans.drop("ANNUAL_INCOME"), credit_history, payment_by_customer(payments),
        performance.drop("DEFAULT_FLAG", "LOAN_AMOUNT", "ANNUAL_INCOME", "ANNUAL_REPAYMENT"))


def _joined(customers: DataFrame, *sides: DataFrame) -> DataFrame:
    """Every customer with the matching row of each side, if any; all sides have one row per customer."""
    rows = customers
    for side in sides:
        rows = rows.join(side, "CUSTOMER_ID", "left")
    return rows.withColumn("DTI_CATEGORY", dti_category(F.col("DTI_PCT"))).selectExpr(*_FEATURES)
