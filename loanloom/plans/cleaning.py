"""Raw tables to cleaned tables.

The rules of a table are applied together (one ``withColumns`` or ``select``), so a derived column always reads the raw
value even where a cleaned column has the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.rounding import round_half_away_rows
from loanloom.functions.rules import (clamp_at_zero, clean_text, flag, null_if_negative, null_unless_positive,
                                      unknown_if_null, years_employed, years_from_days, zero_if_null)
from loanloom.operators.dedup import first_per_key, latest_per_key
from loanloom.sources.schemas import APPLICATION, BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS


def _with(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all ``columns``. Plain IS NOT NULL tests, which reach the file reader."""
    return rows.filter(" AND ".join(f"{column} IS NOT NULL" for column in columns))


def _each(rule: Callable[[Column], Column], columns: str) -> dict[str, Column]:
    """The rule applied to each of the columns, under the same name."""
    return {column: rule(F.col(column)) for column in columns.split()}


def dedup_application(raw: DataFrame) -> DataFrame:
    """One row per customer. Which of several rows is kept does not matter to the result's meaning."""
    return first_per_key(_with(raw, "SK_ID_CURR"), "SK_ID_CURR")


def dedup_bureau(raw: DataFrame) -> DataFrame:
    """The most recently updated row per bureau credit."""
    return latest_per_key(_with(raw, "SK_ID_CURR", "SK_ID_BUREAU"), "SK_ID_BUREAU", "DAYS_CREDIT_UPDATE")


def dedup_previous(raw: DataFrame) -> DataFrame:
    """The most recently decided row per previous loan."""
    return latest_per_key(_with(raw, "SK_ID_CURR", "SK_ID_PREV"), "SK_ID_PREV", "DAYS_DECISION")


def clean_application(raw: DataFrame) -> DataFrame:
    return dedup_application(raw).withColumns({
        **_each(clean_text, "CODE_GENDER"),
        **_each(null_unless_positive, "AMT_INCOME_TOTAL AMT_CREDIT"),
        **_each(unknown_if_null, "OCCUPATION_TYPE ORGANIZATION_TYPE"),
        "AGE_YEARS": years_from_days(F.col("DAYS_BIRTH")),
        "YEARS_EMPLOYED": years_employed(F.col("DAYS_EMPLOYED")),
    }).selectExpr(
        "SK_ID_CURR", "TARGET", "NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY",
        "CNT_CHILDREN", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_TYPE_SUITE",
        "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "AGE_YEARS",
        "YEARS_EMPLOYED", "OCCUPATION_TYPE", "CNT_FAM_MEMBERS", "REGION_RATING_CLIENT", "ORGANIZATION_TYPE")


def clean_bureau(raw: DataFrame) -> DataFrame:
    return dedup_bureau(raw).withColumns({
        **_each(clean_text, "CREDIT_ACTIVE CREDIT_CURRENCY CREDIT_TYPE"),
        **_each(null_if_negative,
                "AMT_CREDIT_MAX_OVERDUE AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT"),
        **_each(zero_if_null, "AMT_CREDIT_SUM_OVERDUE AMT_ANNUITY"),
    })


def clean_previous(raw: DataFrame) -> DataFrame:
    return dedup_previous(raw).withColumns({
        **_each(clean_text, "NAME_CONTRACT_TYPE NAME_CONTRACT_STATUS"),
        **_each(null_if_negative, "AMT_ANNUITY AMT_CREDIT AMT_DOWN_PAYMENT CNT_PAYMENT"),
        **_each(null_unless_positive, "AMT_APPLICATION AMT_GOODS_PRICE"),
        **_each(unknown_if_null, "NAME_PAYMENT_TYPE CODE_REJECT_REASON NAME_CLIENT_TYPE NAME_PRODUCT_TYPE"),
    })


def clean_installments(raw: DataFrame) -> DataFrame:
    """Rows without a scheduled amount are dropped by the raw amount: a negative one stays, as NULL. An instalment
    never paid has no entry day and counts as not late."""
    due, paid = F.col("DAYS_INSTALMENT"), F.col("DAYS_ENTRY_PAYMENT")
    return _with(raw, "SK_ID_CURR", "SK_ID_PREV", "AMT_INSTALMENT").withColumns({
        **_each(null_if_negative, "AMT_INSTALMENT AMT_PAYMENT"),
        "DAYS_LATE": paid - due,
        "IS_LATE_PAYMENT": flag(paid > due),
    })


def clean_pos(raw: DataFrame) -> DataFrame:
    return _with(raw, "SK_ID_CURR", "SK_ID_PREV").withColumns({
        **_each(null_if_negative, "CNT_INSTALMENT CNT_INSTALMENT_FUTURE"),
        **_each(clean_text, "NAME_CONTRACT_STATUS"),
        **_each(clamp_at_zero, "SK_DPD SK_DPD_DEF"),
        "IS_DELINQUENT": flag(F.col("SK_DPD") > 0),
    })


def clean_card(raw: DataFrame) -> DataFrame:
    """Utilisation divides the raw balance by the raw limit and may be negative."""
    limit, minimum = F.col("AMT_CREDIT_LIMIT_ACTUAL"), F.col("AMT_INST_MIN_REGULAR")
    months = _with(raw, "SK_ID_CURR", "SK_ID_PREV").selectExpr(
        "SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL",
        "AMT_DRAWINGS_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT", "AMT_INST_MIN_REGULAR", "CNT_DRAWINGS_CURRENT",
        "SK_DPD", "SK_DPD_DEF")
    return months.withColumns({
        **_each(null_if_negative,
                "AMT_BALANCE AMT_DRAWINGS_CURRENT AMT_PAYMENT_TOTAL_CURRENT AMT_INST_MIN_REGULAR"),
        **_each(null_unless_positive, "AMT_CREDIT_LIMIT_ACTUAL"),
        **_each(zero_if_null, "CNT_DRAWINGS_CURRENT"),
        **_each(clamp_at_zero, "SK_DPD SK_DPD_DEF"),
        "MONTHLY_CREDIT_UTILIZATION": F.when(limit > 0, round_half_away_rows(F.col("AMT_BALANCE") / limit, 4)),
        "IS_BELOW_MIN_PAYMENT": flag((F.col("AMT_PAYMENT_TOTAL_CURRENT") < minimum) & (minimum > 0)),
    })


CLEANERS = {APPLICATION: clean_application, BUREAU: clean_bureau, PREVIOUS: clean_previous,
            INSTALLMENTS: clean_installments, POS: clean_pos, CARD: clean_card}
