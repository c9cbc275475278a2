"""The expected result of every query as one DuckDB statement over the test tables.

Written against the definitions, not the Spark plans: payment totals come from the literal pairing of instalments and
POS months, the star schema is joined table by table, scores are added up in SQL. Shared with the Spark side are only
the derivation expressions of the raw test data and the damage done to CSV files.
"""

from __future__ import annotations

import re

from loanloom.plans.trial import DAMAGE
from loanloom.sources.fixtures import fixture_casts
from loanloom.sources.schemas import RAW_TABLES

# --- raw tables ------------------------------------------------------------------------------------------------------

_BASES = {
    "application_train": """
        b AS (SELECT c_custkey AS k, c_acctbal AS ab, c_nationkey AS nk, c_mktsegment AS seg FROM customer),
        r AS (SELECT k, k AS id, ab, nk, seg FROM b
              UNION ALL SELECT k, k, ab, nk, seg FROM b WHERE k % 50 = 0
              UNION ALL SELECT k, NULL, ab, nk, seg FROM b WHERE k % 100 = 1)""",
    "bureau": """
        o AS (SELECT o_orderkey AS k, if(o_orderkey % 97 = 0, o_custkey + 100000000, o_custkey) AS c,
                     o_orderstatus AS st, o_totalprice AS tp, o_orderpriority AS pr
              FROM orders WHERE o_custkey % 20 <> 0),
        r AS (SELECT k, k AS bid, c, st, tp, pr, if(k % 150 = 0, NULL, -(k % 400)) AS u FROM o
              UNION ALL SELECT k, k, c, st, tp * 0.5e0, pr, -(k % 400) - 1000 FROM o WHERE k % 30 = 0
              UNION ALL SELECT k, NULL, c, st, tp, pr, -1 FROM o WHERE k % 211 = 0)""",
    "previous_application": """
        o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_totalprice AS tp, o_orderpriority AS pr
              FROM orders),
        r AS (SELECT *, k AS pid, if(k % 80 = 0, NULL, -(k % 900)) AS d, 0 AS ver FROM o
              UNION ALL SELECT *, k, -(k % 900) - 1000, 1 FROM o WHERE k % 40 = 0
              UNION ALL SELECT *, NULL, -1, 0 FROM o WHERE k % 499 = 3)""",
    "installments_payments": """
        r AS (SELECT l_orderkey AS k, o_custkey AS c, l_linenumber AS ln, l_partkey AS pk, l_quantity AS qty,
                     l_extendedprice AS ep, l_discount AS dc
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "pos_cash_balance": """
        r AS (SELECT o_orderkey AS k, o_custkey AS c, m, if((k * m) % 29 = 0, k % 150 - 5, 0) AS dpd
              FROM orders, unnest([1, 2, 3]) AS month(m) WHERE m <= o_orderkey % 4)""",
    "credit_card_balance": """
        r AS (SELECT event_id AS e, user_id AS u, value AS v FROM events)""",
}


def _raw(table: str) -> str:
    return f"WITH {_BASES[table]} SELECT {', '.join(fixture_casts(table))} FROM r"


# --- cleaned tables --------------------------------------------------------------------------------------------------

def _replace(**rules: str) -> str:
    """``REPLACE`` list of a star select: per rule template the columns it applies to."""
    templates = {
        "text": "upper(trim({0}))", "positive": "if({0} > 0, {0}, NULL)", "not_negative": "if({0} < 0, NULL, {0})",
        "zero": "ifnull({0}, 0)", "unknown": "ifnull({0}, 'Unknown')", "clamp": "if({0} < 0, 0, {0})",
    }
    return ", ".join(f"{templates[rule].format(column)} AS {column}"
                     for rule, columns in rules.items() for column in columns.split())


_CTES = {f"raw_{table}": _raw(table) for table in RAW_TABLES}

_CTES["d_application"] = """
    SELECT * FROM raw_application_train WHERE SK_ID_CURR IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY SK_ID_CURR) = 1"""
_CTES["d_bureau"] = """
    SELECT * FROM raw_bureau WHERE SK_ID_CURR IS NOT NULL AND SK_ID_BUREAU IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY SK_ID_BUREAU ORDER BY DAYS_CREDIT_UPDATE DESC NULLS FIRST) = 1"""
_CTES["d_previous"] = """
    SELECT * FROM raw_previous_application WHERE SK_ID_CURR IS NOT NULL AND SK_ID_PREV IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY SK_ID_PREV ORDER BY DAYS_DECISION DESC NULLS FIRST) = 1"""

_CTES["c_application"] = f"""
    SELECT * EXCLUDE (DAYS_BIRTH, DAYS_EMPLOYED) REPLACE ({_replace(
        text="CODE_GENDER", positive="AMT_INCOME_TOTAL AMT_CREDIT", unknown="OCCUPATION_TYPE ORGANIZATION_TYPE")}),
        abs(DAYS_BIRTH) / 365 AS AGE_YEARS,
        abs(nullif(DAYS_EMPLOYED, 365243)) / 365 AS YEARS_EMPLOYED
    FROM d_application"""
_CTES["c_bureau"] = f"""
    SELECT * REPLACE ({_replace(
        text="CREDIT_ACTIVE CREDIT_CURRENCY CREDIT_TYPE",
        not_negative="AMT_CREDIT_MAX_OVERDUE AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT",
        zero="AMT_CREDIT_SUM_OVERDUE AMT_ANNUITY")})
    FROM d_bureau"""
_CTES["c_previous"] = f"""
    SELECT * REPLACE ({_replace(
        text="NAME_CONTRACT_TYPE NAME_CONTRACT_STATUS",
        not_negative="AMT_ANNUITY AMT_CREDIT AMT_DOWN_PAYMENT CNT_PAYMENT",
        positive="AMT_APPLICATION AMT_GOODS_PRICE",
        unknown="NAME_PAYMENT_TYPE CODE_REJECT_REASON NAME_CLIENT_TYPE NAME_PRODUCT_TYPE")})
    FROM d_previous"""
_CTES["c_installments"] = f"""
    SELECT * REPLACE ({_replace(not_negative="AMT_INSTALMENT AMT_PAYMENT")}),
        DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS DAYS_LATE,
        CAST(ifnull(DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT, false) AS INT) AS IS_LATE_PAYMENT
    FROM raw_installments_payments
    WHERE SK_ID_CURR IS NOT NULL AND SK_ID_PREV IS NOT NULL AND AMT_INSTALMENT IS NOT NULL"""
_CTES["c_pos"] = f"""
    SELECT t.* REPLACE ({_replace(not_negative="CNT_INSTALMENT CNT_INSTALMENT_FUTURE", text="NAME_CONTRACT_STATUS",
                                  clamp="SK_DPD SK_DPD_DEF")}),
        CAST(ifnull(t.SK_DPD > 0, false) AS INT) AS IS_DELINQUENT
    FROM raw_pos_cash_balance t WHERE SK_ID_CURR IS NOT NULL AND SK_ID_PREV IS NOT NULL"""
_CTES["c_card"] = f"""
    SELECT t.SK_ID_PREV, t.SK_ID_CURR, t.MONTHS_BALANCE, {_replace(
        not_negative="t.AMT_BALANCE", positive="t.AMT_CREDIT_LIMIT_ACTUAL").replace("AS t.", "AS ")},
        {_replace(not_negative="t.AMT_DRAWINGS_CURRENT t.AMT_PAYMENT_TOTAL_CURRENT t.AMT_INST_MIN_REGULAR",
                  zero="t.CNT_DRAWINGS_CURRENT", clamp="t.SK_DPD t.SK_DPD_DEF").replace("AS t.", "AS ")},
        if(t.AMT_CREDIT_LIMIT_ACTUAL > 0, round(t.AMT_BALANCE / t.AMT_CREDIT_LIMIT_ACTUAL, 4), NULL)
            AS MONTHLY_CREDIT_UTILIZATION,
        CAST(ifnull(t.AMT_INST_MIN_REGULAR > 0 AND t.AMT_PAYMENT_TOTAL_CURRENT < t.AMT_INST_MIN_REGULAR, false) AS INT)
            AS IS_BELOW_MIN_PAYMENT
    FROM raw_credit_card_balance t WHERE SK_ID_CURR IS NOT NULL AND SK_ID_PREV IS NOT NULL"""

# --- star schema -----------------------------------------------------------------------------------------------------


def _tiers(*tiers: tuple[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in tiers) + f" ELSE {default} END"


def _total(amount: str) -> str:
    return f"round(sum(ifnull({amount}, 0)), 4)"


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _mean(column: str, places: int) -> str:
    """Mean of values with ``places`` decimals, rounded to as many; counted in whole units of the last place."""
    return f"round(avg(round({column} * 1e{places}))) / 1e{places}"


_CTES["s_customer"] = f"""
    SELECT SK_ID_CURR AS CUSTOMER_ID, CODE_GENDER AS GENDER, AGE_YEARS AS AGE,
        {_tiers(("AGE_YEARS < 25", "'Under 25'"), ("AGE_YEARS >= 25 AND AGE_YEARS <= 34", "'25-34'"),
                ("AGE_YEARS >= 35 AND AGE_YEARS <= 44", "'35-44'"),
                ("AGE_YEARS >= 45 AND AGE_YEARS <= 54", "'45-54'"), default="'55+'")} AS AGE_BAND,
        NAME_EDUCATION_TYPE AS EDUCATION, NAME_FAMILY_STATUS AS FAMILY_STATUS, NAME_HOUSING_TYPE AS HOUSING_TYPE,
        CNT_CHILDREN AS NUM_CHILDREN, CNT_FAM_MEMBERS AS FAMILY_SIZE, OCCUPATION_TYPE AS OCCUPATION,
        ORGANIZATION_TYPE AS EMPLOYER_TYPE, YEARS_EMPLOYED,
        {_tiers(("YEARS_EMPLOYED IS NULL", "'Unemployed'"), ("YEARS_EMPLOYED < 2", "'Under 2 Years'"),
                ("YEARS_EMPLOYED <= 5", "'2-5 Years'"), ("YEARS_EMPLOYED <= 10", "'5-10 Years'"),
                default="'10+ Years'")} AS EMPLOYMENT_BAND,
        NAME_INCOME_TYPE AS INCOME_TYPE, AMT_INCOME_TOTAL AS ANNUAL_INCOME,
        {_tiers(("AMT_INCOME_TOTAL < 1e5", "'Low (<100K)'"), ("AMT_INCOME_TOTAL <= 2e5", "'Medium (100-200K)'"),
                ("AMT_INCOME_TOTAL <= 5e5", "'High (200-500K)'"), default="'Very High (500K+)'")} AS INCOME_BAND,
        REGION_RATING_CLIENT AS REGION_RATING, TARGET AS DEFAULT_FLAG
    FROM c_application"""
_CTES["s_loan"] = f"""
    SELECT a.SK_ID_CURR AS CUSTOMER_ID, any_value(a.NAME_CONTRACT_TYPE) AS CONTRACT_TYPE,
        any_value(a.AMT_CREDIT) AS LOAN_AMOUNT, any_value(a.AMT_ANNUITY) AS ANNUAL_REPAYMENT,
        any_value(a.AMT_GOODS_PRICE) AS GOODS_PRICE, any_value(a.AMT_INCOME_TOTAL) AS ANNUAL_INCOME,
        round(LOAN_AMOUNT / ANNUAL_INCOME, 4) AS DEBT_TO_INCOME_RATIO,
        round(LOAN_AMOUNT / ANNUAL_INCOME * 100, 4) AS DTI_PCT,
        round(ANNUAL_REPAYMENT / (ANNUAL_INCOME / 12), 4) AS LOAN_BURDEN_SCORE,
        count(p.SK_ID_PREV) AS TOTAL_PREV_APPLICATIONS,
        {_count("p.NAME_CONTRACT_STATUS = 'APPROVED'")} AS PREV_APPROVED,
        {_count("p.NAME_CONTRACT_STATUS = 'REFUSED'")} AS PREV_REFUSED,
        {_count("p.NAME_CONTRACT_STATUS = 'CANCELED'")} AS PREV_CANCELED
    FROM c_application a LEFT JOIN c_previous p USING (SK_ID_CURR) GROUP BY a.SK_ID_CURR"""
_CTES["s_credit"] = f"""
    SELECT SK_ID_CURR AS CUSTOMER_ID, count(*) AS TOTAL_BUREAU_RECORDS,
        {_count("CREDIT_ACTIVE = 'ACTIVE'")} AS ACTIVE_CREDITS, {_count("CREDIT_ACTIVE = 'CLOSED'")} AS CLOSED_CREDITS,
        {_total("AMT_CREDIT_SUM")} AS TOTAL_CREDIT_SUM, {_total("AMT_CREDIT_SUM_DEBT")} AS TOTAL_DEBT,
        {_total("AMT_CREDIT_SUM_OVERDUE")} AS TOTAL_OVERDUE,
        max(ifnull(AMT_CREDIT_MAX_OVERDUE, 0)) AS MAX_OVERDUE,
        CAST(sum(ifnull(CREDIT_DAY_OVERDUE, 0)) AS BIGINT) AS TOTAL_DAYS_OVERDUE,
        {_count("CREDIT_DAY_OVERDUE > 0")} AS PREV_DEFAULT_COUNT,
        count(DISTINCT CREDIT_TYPE) AS DISTINCT_CREDIT_TYPES, max(DAYS_CREDIT_UPDATE) AS LAST_BUREAU_UPDATE
    FROM c_bureau GROUP BY ALL"""


def _payments(source: str) -> str:
    return f"""
    SELECT SK_ID_CURR AS CUSTOMER_ID, SK_ID_PREV AS PREV_LOAN_ID,
        count(NUM_INSTALMENT_NUMBER) AS TOTAL_INSTALLMENTS, CAST(sum(IS_LATE_PAYMENT) AS BIGINT) AS LATE_PAYMENTS,
        round(sum(IS_LATE_PAYMENT) * 1e2 / count(*), 4) AS MISSED_PAYMENT_RATIO,
        round(avg(DAYS_LATE) FILTER (WHERE DAYS_LATE > 0), 2) AS AVG_DAYS_LATE,
        max(DAYS_LATE) FILTER (WHERE DAYS_LATE > 0) AS MAX_DAYS_LATE,
        {_total("AMT_INSTALMENT")} AS TOTAL_SCHEDULED, {_total("AMT_PAYMENT")} AS TOTAL_PAID,
        round(TOTAL_PAID * 1e2 / nullif(TOTAL_SCHEDULED, 0), 4) AS PAYMENT_RATIO_PCT,
        max(ifnull(SK_DPD_DEF, 0)) AS MAX_DPD,
        CAST(sum(ifnull(IS_DELINQUENT, 0)) AS BIGINT) AS DELINQUENT_MONTHS
    FROM {source} GROUP BY ALL"""


_CTES["s_payment"] = _payments("""
        (SELECT i.*, p.SK_DPD_DEF, p.IS_DELINQUENT
         FROM c_installments i LEFT JOIN c_pos p USING (SK_ID_CURR, SK_ID_PREV))""")
_CTES["s_payment_once"] = """
    SELECT f.* REPLACE (ifnull(p.months, 0) AS DELINQUENT_MONTHS, ifnull(p.dpd, 0) AS MAX_DPD)
    FROM (""" + _payments("(SELECT *, 0 AS SK_DPD_DEF, 0 AS IS_DELINQUENT FROM c_installments)") + """) f
    LEFT JOIN (SELECT SK_ID_CURR AS c, SK_ID_PREV AS l, max(SK_DPD_DEF) AS dpd,
                      CAST(sum(IS_DELINQUENT) AS BIGINT) AS months FROM c_pos GROUP BY ALL) p
      ON p.c = f.CUSTOMER_ID AND p.l = f.PREV_LOAN_ID"""
_CTES["s_performance"] = f"""
    SELECT a.SK_ID_CURR AS CUSTOMER_ID, any_value(a.TARGET) AS DEFAULT_FLAG, any_value(a.AMT_CREDIT) AS LOAN_AMOUNT,
        any_value(a.AMT_INCOME_TOTAL) AS ANNUAL_INCOME, any_value(a.AMT_ANNUITY) AS ANNUAL_REPAYMENT,
        round(avg(round(k.MONTHLY_CREDIT_UTILIZATION * 1e4))) / 1e2 AS AVG_CREDIT_UTILIZATION_PCT,
        {_count("k.IS_BELOW_MIN_PAYMENT = 1")} AS BELOW_MIN_PAYMENT_COUNT,
        {_total("k.AMT_DRAWINGS_CURRENT")} AS TOTAL_CC_DRAWINGS,
        round({_total("k.AMT_BALANCE")} / count(*), 2) AS AVG_CC_BALANCE,
        max(ifnull(k.SK_DPD_DEF, 0)) AS MAX_CC_DPD
    FROM c_application a LEFT JOIN c_card k USING (SK_ID_CURR) GROUP BY a.SK_ID_CURR"""

# --- features and scores ---------------------------------------------------------------------------------------------

_CTES["payment_rollup"] = f"""
    SELECT CUSTOMER_ID, {_mean("MISSED_PAYMENT_RATIO", 4)} AS MISSED_PAYMENT_RATIO,
        {_mean("AVG_DAYS_LATE", 2)} AS AVG_DAYS_LATE, max(MAX_DAYS_LATE) AS MAX_DAYS_LATE, max(MAX_DPD) AS MAX_DPD,
        CAST(sum(DELINQUENT_MONTHS) AS BIGINT) AS DELINQUENT_MONTHS,
        {_mean("PAYMENT_RATIO_PCT", 4)} AS PAYMENT_RATIO_PCT
    FROM s_payment GROUP BY CUSTOMER_ID"""


def _or(value: int, *columns: str) -> str:
    return ", ".join(f"ifnull({column}, {value}) AS {column.split('.')[-1]}" for column in columns)


_CTES["features"] = f"""
    SELECT c.* EXCLUDE (NUM_CHILDREN, FAMILY_SIZE), l.DTI_PCT,
        {_tiers(("l.DTI_PCT > 300", "'High DTI'"), ("l.DTI_PCT >= 150", "'Medium DTI'"), default="'Low DTI'")}
            AS DTI_CATEGORY,
        l.LOAN_BURDEN_SCORE, l.LOAN_AMOUNT, l.ANNUAL_REPAYMENT, l.TOTAL_PREV_APPLICATIONS, l.PREV_APPROVED,
        l.PREV_REFUSED, l.PREV_CANCELED,
        {_or(0, "h.TOTAL_BUREAU_RECORDS", "h.ACTIVE_CREDITS", "h.CLOSED_CREDITS", "h.TOTAL_DEBT", "h.TOTAL_OVERDUE",
             "h.MAX_OVERDUE", "h.TOTAL_DAYS_OVERDUE", "h.PREV_DEFAULT_COUNT")},
        {_or(0, "p.MISSED_PAYMENT_RATIO", "p.AVG_DAYS_LATE", "p.MAX_DAYS_LATE", "p.MAX_DPD", "p.DELINQUENT_MONTHS")},
        {_or(100, "p.PAYMENT_RATIO_PCT")},
        {_or(0, "f.AVG_CREDIT_UTILIZATION_PCT", "f.BELOW_MIN_PAYMENT_COUNT", "f.MAX_CC_DPD", "f.AVG_CC_BALANCE")}
    FROM s_customer c LEFT JOIN s_loan l USING (CUSTOMER_ID) LEFT JOIN s_credit h USING (CUSTOMER_ID)
    LEFT JOIN payment_rollup p USING (CUSTOMER_ID) LEFT JOIN s_performance f USING (CUSTOMER_ID)"""


def _points(*tiers: tuple[int, str]) -> str:
    """Points of the first tier that holds, 0 if none does."""
    return f"CAST({_tiers(*[(test, str(points)) for points, test in tiers], default='0')} AS INT)"


_CTES["points"] = f"""
    SELECT CUSTOMER_ID,
        {_points((30, "DTI_PCT > 300"), (15, "DTI_PCT >= 150 AND DTI_PCT <= 300"))} AS PTS_DTI,
        {_points((25, "PREV_DEFAULT_COUNT >= 1"))} AS PTS_PREV_DEFAULT,
        {_points((20, "YEARS_EMPLOYED IS NULL OR YEARS_EMPLOYED < 2"))} AS PTS_EMPLOYMENT,
        {_points((15, "AVG_CREDIT_UTILIZATION_PCT > 80"),
                 (8, "AVG_CREDIT_UTILIZATION_PCT >= 50 AND AVG_CREDIT_UTILIZATION_PCT <= 80"))} AS PTS_UTILIZATION,
        {_points((10, "MISSED_PAYMENT_RATIO > 20"), (5, "MISSED_PAYMENT_RATIO >= 10 AND MISSED_PAYMENT_RATIO <= 20"))}
            AS PTS_MISSED_PAYMENTS,
        {_points((10, "PREV_REFUSED >= 2"), (5, "PREV_REFUSED = 1"))} AS PTS_REFUSALS,
        {_points((10, "MAX_DPD > 90"), (5, "MAX_DPD >= 30 AND MAX_DPD <= 90"))} AS PTS_MAX_DPD,
        {_points((5, "DELINQUENT_MONTHS > 5"))} AS PTS_DELINQUENCY
    FROM features"""
_CTES["scores"] = f"""
    SELECT t.* EXCLUDE (EMPLOYER_TYPE, ANNUAL_REPAYMENT, PREV_APPROVED, PREV_CANCELED, TOTAL_BUREAU_RECORDS,
                        ACTIVE_CREDITS, CLOSED_CREDITS, MAX_OVERDUE, TOTAL_DAYS_OVERDUE, MAX_DAYS_LATE,
                        BELOW_MIN_PAYMENT_COUNT, MAX_CC_DPD, AVG_CC_BALANCE),
        s.RISK_SCORE,
        {_tiers(("s.RISK_SCORE < 31", "'Low Risk'"), ("s.RISK_SCORE < 61", "'Medium Risk'"), default="'High Risk'")}
            AS RISK_CATEGORY,
        if(s.RISK_SCORE < 61, 0, t.LOAN_AMOUNT) AS HIGH_RISK_EXPOSURE
    FROM features t JOIN (
        SELECT CUSTOMER_ID, CAST(PTS_DTI + PTS_PREV_DEFAULT + PTS_EMPLOYMENT + PTS_UTILIZATION + PTS_MISSED_PAYMENTS
                                 + PTS_REFUSALS + PTS_MAX_DPD + PTS_DELINQUENCY AS INT) AS RISK_SCORE
        FROM points) s USING (CUSTOMER_ID)"""


def statement(select: str) -> str:
    """``select`` with the tables it needs, directly or through others, as CTEs in front."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(_CTES[name])

    visit(select)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in _CTES.items() if name in needed)
    return f"WITH {ctes}\n{select}"


# --- queries ---------------------------------------------------------------------------------------------------------

_RATE = "round(avg(DEFAULT_FLAG) * 100, 2) AS default_rate_pct"
_SCORE = "round(avg(RISK_SCORE), 2) AS avg_risk_score"


def _by(group: str, source: str, *more: str) -> str:
    return f"SELECT {', '.join((group, 'count(*) AS customers', _RATE, *more))} FROM {source} GROUP BY ALL"


def _flag_rate(flag: str, source: str, hits: str, total: str, rate: str) -> str:
    return f"""SELECT CAST(sum({flag}) AS BIGINT) AS {hits}, count(*) AS {total},
        round({hits} * 1e2 / {total}, 2) AS {rate} FROM {source}"""


def _counts(**tables: str) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS table_name, count(*) AS row_count FROM {name}"
                              for label, name in tables.items())


def _metrics(name: str, source: str, key: str | None = None, **metrics: str) -> str:
    """One row per metric of a stored table; keys are counted here, not numbered."""
    own = {"row_count": "count(*)", **metrics}
    if key:
        own |= {"repeated_keys": f"count({key}) - count(DISTINCT {key})", "missing_keys": f"count(*) - count({key})"}
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}"
                              for metric, value in own.items())


def _rebuild_metrics() -> str:
    def percent(flag: str) -> str:
        return f"avg({flag}) * 100"

    customer = "CUSTOMER_ID"
    return " UNION ALL ".join([
        *[_metrics(f"raw_data.{table}", f"raw_{table}") for table in RAW_TABLES],
        _metrics("cleaned_data.application_train", "c_application", "SK_ID_CURR"),
        _metrics("cleaned_data.bureau", "c_bureau", min_credit_sum="min(AMT_CREDIT_SUM)", min_debt="min(AMT_CREDIT_SUM_DEBT)",
                 min_overdue="min(AMT_CREDIT_MAX_OVERDUE)"),
        _metrics("cleaned_data.previous_application", "c_previous"),
        _metrics("cleaned_data.installments_payments", "c_installments", late_payment_pct=percent("IS_LATE_PAYMENT")),
        _metrics("cleaned_data.pos_cash_balance", "c_pos", delinquency_rate_pct=percent("IS_DELINQUENT")),
        _metrics("cleaned_data.credit_card_balance", "c_card", below_min_pct=percent("IS_BELOW_MIN_PAYMENT"),
                 avg_utilization_pct="round(avg(round(MONTHLY_CREDIT_UTILIZATION * 1e4))) / 1e2"),
        _metrics("analytics.dim_customer", "s_customer", customer),
        _metrics("analytics.dim_loan", "s_loan", customer),
        _metrics("analytics.dim_credit_history", "s_credit", customer, avg_bureau_records="avg(TOTAL_BUREAU_RECORDS)",
                 max_prev_defaults="max(PREV_DEFAULT_COUNT)"),
        _metrics("analytics.fact_payment_history", "s_payment",
                 avg_missed_pct="round(avg(round(MISSED_PAYMENT_RATIO * 1e4)) / 1e2) / 1e2",
                 avg_payment_ratio="round(avg(round(PAYMENT_RATIO_PCT * 1e4)) / 1e2) / 1e2"),
        _metrics("analytics.fact_loan_performance", "s_performance", customer),
        _metrics("analytics.customer_risk_features", "features", customer),
        _metrics("analytics.customer_risk_scores", "scores", customer, default_rate_pct=percent("DEFAULT_FLAG"),
                 min_score="min(RISK_SCORE)", max_score="max(RISK_SCORE)")])


def _csv_rejects() -> str:
    return " UNION ALL ".join(f"""SELECT '{table}' AS table_name, '{column}' AS column_name, '{text}' AS text,
        count(*) FILTER (WHERE {where}) AS rejected_values, rejected_values AS rejected_rows,
        count(*) - rejected_values AS row_count FROM raw_{table} HAVING rejected_values > 0"""
                              for table, (column, where, text) in DAMAGE.items())


_QUERIES = {
    "rebuild_metrics": _rebuild_metrics(),
    "csv_rejects": _csv_rejects(),
    "load_raw_counts": _counts(**{table: f"raw_{table}" for table in RAW_TABLES}),
    **{f"raw_{table}": f"SELECT * FROM raw_{table}" for table in RAW_TABLES},
    "dedup_application": "SELECT * FROM d_application",
    "dedup_bureau": "SELECT * FROM d_bureau",
    "dedup_previous": "SELECT * FROM d_previous",
    "clean_application": "SELECT * FROM c_application",
    "clean_bureau": "SELECT * FROM c_bureau",
    "clean_previous": "SELECT * FROM c_previous",
    "clean_installments": "SELECT * FROM c_installments",
    "clean_pos": "SELECT * FROM c_pos",
    "clean_card": "SELECT * FROM c_card",
    "table_counts": _counts(
        application_train="c_application", dim_customer="s_customer", dim_loan="s_loan",
        dim_credit_history="s_credit", fact_payment_history="s_payment", customer_risk_features="features",
        customer_risk_scores="scores"),
    "bureau_minima": """SELECT min(AMT_CREDIT_SUM) AS min_credit_sum, min(AMT_CREDIT_SUM_DEBT) AS min_debt,
        min(AMT_CREDIT_MAX_OVERDUE) AS min_overdue FROM c_bureau""",
    "status_distribution": """SELECT NAME_CONTRACT_STATUS, count(*) AS count,
        round(count * 1e2 / (SELECT count(*) FROM c_previous), 2) AS percentage FROM c_previous GROUP BY ALL""",
    "late_payment_rate": _flag_rate("IS_LATE_PAYMENT", "c_installments", "late_payments", "total_payments",
                                    "late_payment_pct"),
    "delinquency_rate": _flag_rate("IS_DELINQUENT", "c_pos", "delinquent_months", "total_months",
                                   "delinquency_rate_pct"),
    "card_metrics": """SELECT CAST(sum(IS_BELOW_MIN_PAYMENT) AS BIGINT) AS below_min_count, count(*) AS total_records,
        round(below_min_count * 1e2 / total_records, 2) AS below_min_pct,
        round(avg(round(MONTHLY_CREDIT_UTILIZATION * 1e4))) / 1e2 AS avg_utilization_pct FROM c_card""",
    "dim_customer": "SELECT * FROM s_customer",
    "age_band": "SELECT AGE_BAND, count(*) AS customers, min(AGE) AS min_age, max(AGE) AS max_age "
                "FROM s_customer GROUP BY ALL",
    "employment_band": "SELECT EMPLOYMENT_BAND, count(*) AS customers, min(YEARS_EMPLOYED) AS min_years, "
                       "max(YEARS_EMPLOYED) AS max_years FROM s_customer GROUP BY ALL",
    "income_band": "SELECT INCOME_BAND, count(*) AS customers, min(ANNUAL_INCOME) AS min_income, "
                   "max(ANNUAL_INCOME) AS max_income FROM s_customer GROUP BY ALL",
    "dim_loan": "SELECT * FROM s_loan",
    "dim_credit_history": "SELECT * FROM s_credit",
    "credit_history_stats": """SELECT round(avg(TOTAL_BUREAU_RECORDS), 2) AS avg_bureau_records,
        round(avg(PREV_DEFAULT_COUNT), 2) AS avg_prev_defaults, max(PREV_DEFAULT_COUNT) AS max_prev_defaults
        FROM s_credit""",
    "fact_payment_history": "SELECT * FROM s_payment",
    "fact_payment_history_true": "SELECT * FROM s_payment_once",
    "payment_stats": """SELECT round(avg(round(MISSED_PAYMENT_RATIO * 1e4)) / 1e2) / 1e2 AS avg_missed_pct,
        round(avg(round(PAYMENT_RATIO_PCT * 1e4)) / 1e2) / 1e2 AS avg_payment_ratio, max(MAX_DPD) AS worst_dpd_ever,
        round(avg(MAX_DAYS_LATE), 2) AS avg_max_days_late FROM s_payment""",
    "payment_by_customer": "SELECT * FROM payment_rollup",
    "fact_loan_performance": "SELECT * FROM s_performance",
    "default_distribution": """SELECT DEFAULT_FLAG, count(*) AS customers,
        round(customers * 1e2 / (SELECT count(*) FROM s_performance), 2) AS pct FROM s_performance GROUP BY ALL""",
    "customer_risk_features": "SELECT * FROM features",
    "dti_category": "SELECT DTI_CATEGORY, count(*) AS customers, min(DTI_PCT) AS min_dti, max(DTI_PCT) AS max_dti "
                    "FROM features GROUP BY ALL",
    "feature_means": f"""SELECT round(avg(round(DTI_PCT * 1e4)) / 1e2) / 1e2 AS avg_dti,
        {_mean("LOAN_BURDEN_SCORE", 4)} AS avg_burden, round(avg(PREV_DEFAULT_COUNT), 4) AS avg_prev_defaults,
        {_mean("MISSED_PAYMENT_RATIO", 4)} AS avg_missed_pmt,
        {_mean("AVG_CREDIT_UTILIZATION_PCT", 2)} AS avg_utilization,
        round(avg(YEARS_EMPLOYED), 2) AS avg_years_employed FROM features""",
    "default_by_dti": _by("DTI_CATEGORY", "features"),
    "default_by_employment": _by("EMPLOYMENT_BAND", "features"),
    "default_by_history": _by(_tiers(
        ("PREV_DEFAULT_COUNT = 0", "'No Previous Defaults'"), ("PREV_DEFAULT_COUNT = 1", "'1 Previous Default'"),
        ("PREV_DEFAULT_COUNT = 2", "'2 Previous Defaults'"), default="'3+ Previous Defaults'") + " AS default_history",
        "features"),
    "risk_points": "SELECT * FROM points",
    "customer_risk_scores": "SELECT * FROM scores",
    "risk_distribution": f"""SELECT RISK_CATEGORY, count(*) AS customers,
        round(customers * 1e2 / (SELECT count(*) FROM scores), 2) AS pct_of_portfolio,
        round(sum(LOAN_AMOUNT) / 1e6, 2) AS exposure_millions, {_SCORE},
        CAST(sum(DEFAULT_FLAG) AS BIGINT) AS actual_defaults_caught,
        round(actual_defaults_caught * 1e2 / customers, 2) AS default_rate_in_segment FROM scores GROUP BY ALL""",
    "portfolio_default_rate": "SELECT round(avg(DEFAULT_FLAG) * 100, 2) AS portfolio_default_rate_pct FROM scores",
    "risk_concentration": f"""SELECT RISK_CATEGORY, count(*) AS customers,
        round(sum(LOAN_AMOUNT) / 1e6, 2) AS total_exposure_millions, {_RATE},
        round(sum(LOAN_AMOUNT) / 1e6 * avg(DEFAULT_FLAG), 2) AS expected_loss_millions FROM scores GROUP BY ALL""",
    "risk_by_age": _by("AGE_BAND", "scores", _SCORE),
    "risk_by_income": _by("INCOME_BAND", "scores"),
    "risk_by_employment": _by("EMPLOYMENT_BAND", "scores", _SCORE),
    "top_high_risk": """SELECT CUSTOMER_ID, RISK_SCORE, RISK_CATEGORY, LOAN_AMOUNT, DTI_PCT, PREV_DEFAULT_COUNT,
        MISSED_PAYMENT_RATIO, AVG_CREDIT_UTILIZATION_PCT, YEARS_EMPLOYED, DEFAULT_FLAG
        FROM scores WHERE RISK_SCORE >= 61 ORDER BY RISK_SCORE DESC, CUSTOMER_ID LIMIT 50""",
}


def statements() -> dict[str, str]:
    return {name: statement(select) for name, select in _QUERIES.items()}
