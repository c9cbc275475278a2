"""The six raw tables derived from the driver's test tables.

The test tables hold no credit data, so each raw column is an expression over ``customer``, ``orders``, ``lineitem``
or ``events``, chosen to reach every branch of the rules (NULL keys, duplicates, negative amounts, ...). The
expressions are plain SQL that other engines read as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanloom.sources.schemas import APPLICATION, BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS, raw_types

# The derivation of every raw column.
FIXTURE_COLUMNS = {
    APPLICATION: {
        "SK_ID_CURR": "id",
        "TARGET": "CASE WHEN (k*31+nk)%12=0 THEN 1 ELSE 0 END",
        "NAME_CONTRACT_TYPE": "CASE WHEN k%10=0 THEN 'Revolving loans' ELSE 'Cash loans' END",
        "CODE_GENDER": "CASE WHEN k%37=0 THEN NULL WHEN k%2=0 THEN ' f ' WHEN k%3=0 THEN 'M' ELSE 'm ' END",
        "FLAG_OWN_CAR": "CASE WHEN k%3=0 THEN 'Y' ELSE 'N' END",
        "FLAG_OWN_REALTY": "CASE WHEN k%5=0 THEN 'N' ELSE 'Y' END",
        "CNT_CHILDREN": "k%4",
        "AMT_INCOME_TOTAL": "ab*60e0",
        "AMT_CREDIT": "(k*7919)%900000",
        "AMT_ANNUITY": "CAST((k*7919)%900000 AS DOUBLE)/20e0",
        "AMT_GOODS_PRICE": "CAST((k*7919)%900000 AS DOUBLE)*0.9e0",
        "NAME_TYPE_SUITE": "CASE WHEN k%4=0 THEN 'Family' ELSE 'Unaccompanied' END",
        "NAME_INCOME_TYPE": "CASE WHEN k%6=0 THEN 'Pensioner' ELSE 'Working' END",
        "NAME_EDUCATION_TYPE": "seg",
        "NAME_FAMILY_STATUS": "CASE WHEN k%2=0 THEN 'Married' ELSE 'Single' END",
        "NAME_HOUSING_TYPE": "CASE WHEN k%7=0 THEN 'Rented' ELSE 'House' END",
        "DAYS_BIRTH": "-(7300+(k*3701)%18000)",
        "DAYS_EMPLOYED": "CASE WHEN k%6=0 THEN 365243 ELSE -((k*5003)%6000) END",
        "OCCUPATION_TYPE": "CASE WHEN k%3=0 THEN NULL ELSE seg END",
        "CNT_FAM_MEMBERS": "1+k%5",
        "REGION_RATING_CLIENT": "1+nk%3",
        "ORGANIZATION_TYPE": "CASE WHEN k%8=0 THEN NULL ELSE 'Org' END",
    },
    BUREAU: {
        "SK_ID_BUREAU": "bid",
        "SK_ID_CURR": "c",
        "CREDIT_ACTIVE": "CASE st WHEN 'F' THEN ' Closed' WHEN 'O' THEN 'Active ' ELSE 'Sold' END",
        "CREDIT_CURRENCY": "CASE WHEN k%13=0 THEN 'currency 2' ELSE ' currency 1' END",
        "DAYS_CREDIT": "-(k%2900)",
        "CREDIT_DAY_OVERDUE": "CASE WHEN k%283=0 THEN k%200 ELSE 0 END",
        "DAYS_CREDIT_ENDDATE": "CASE WHEN k%10=0 THEN NULL ELSE k%3000-1500 END",
        "DAYS_ENDDATE_FACT": "CASE WHEN st='F' THEN -(k%1500) ELSE NULL END",
        "AMT_CREDIT_MAX_OVERDUE": "CASE WHEN k%7=0 THEN NULL ELSE tp*0.01e0-100e0 END",
        "CNT_CREDIT_PROLONG": "k%3",
        "AMT_CREDIT_SUM": "tp-20000e0",
        "AMT_CREDIT_SUM_DEBT": "tp*0.5e0-5000e0",
        "AMT_CREDIT_SUM_LIMIT": "tp*0.1e0-1000e0",
        "AMT_CREDIT_SUM_OVERDUE": "CASE WHEN k%9=0 THEN 10e0 ELSE NULL END",
        "CREDIT_TYPE": "pr",
        "DAYS_CREDIT_UPDATE": "u",
        "AMT_ANNUITY": "CASE WHEN k%2=0 THEN NULL ELSE tp*0.05e0 END",
    },
    PREVIOUS: {
        "SK_ID_PREV": "pid",
        "SK_ID_CURR": "c",
        "NAME_CONTRACT_TYPE": "CASE WHEN k%2=0 THEN 'Cash loans ' ELSE ' Consumer loans' END",
        "AMT_ANNUITY": "tp*0.05e0-200e0",
        "AMT_APPLICATION": "CASE WHEN k%12=0 THEN 0e0 ELSE tp END",
        "AMT_CREDIT": "tp*1.1e0-5000e0",
        "AMT_DOWN_PAYMENT": "CASE WHEN k%6=0 THEN NULL ELSE tp*0.1e0-1000e0 END",
        "AMT_GOODS_PRICE": "CASE WHEN k%14=0 THEN 0e0 ELSE tp*0.9e0 END",
        "NAME_CONTRACT_STATUS": "CASE WHEN ver=1 THEN 'Refused' WHEN k%11=0 THEN ' Refused' WHEN st='P' THEN 'Canceled ' WHEN k%53=0 THEN 'Unused offer' ELSE 'Approved' END",
        "DAYS_DECISION": "d",
        "NAME_PAYMENT_TYPE": "CASE WHEN k%5=0 THEN NULL ELSE 'Cash' END",
        "CODE_REJECT_REASON": "CASE WHEN k%11=0 THEN 'HC' ELSE NULL END",
        "NAME_CLIENT_TYPE": "CASE WHEN k%4=0 THEN NULL ELSE 'Repeater' END",
        "NAME_PRODUCT_TYPE": "CASE WHEN k%3=0 THEN NULL ELSE 'x-sell' END",
        "DAYS_FIRST_DUE": "-(k%800)",
        "DAYS_LAST_DUE": "-(k%400)",
        "CNT_PAYMENT": "k%40-2",
    },
    INSTALLMENTS: {
        "SK_ID_PREV": "CASE WHEN k%501=0 THEN NULL ELSE k END",
        "SK_ID_CURR": "c",
        "NUM_INSTALMENT_VERSION": "k%3",
        "NUM_INSTALMENT_NUMBER": "ln",
        "DAYS_INSTALMENT": "-10-(pk%1000)",
        "DAYS_ENTRY_PAYMENT": "CASE WHEN qty=49e0 THEN NULL ELSE -28-(pk%1000)+(pk*3+ln)%20+c%5 END",
        "AMT_INSTALMENT": "CASE WHEN qty=50e0 THEN NULL ELSE ep-1500e0 END",
        "AMT_PAYMENT": "CASE WHEN qty=49e0 THEN NULL ELSE (ep-1500e0)*(1e0-dc) END",
    },
    POS: {
        "SK_ID_PREV": "k",
        "SK_ID_CURR": "CASE WHEN k%701=0 THEN NULL ELSE c END",
        "MONTHS_BALANCE": "-m",
        "CNT_INSTALMENT": "k%25-1",
        "CNT_INSTALMENT_FUTURE": "k%20-1",
        "NAME_CONTRACT_STATUS": "CASE WHEN k%3=0 THEN 'Completed ' ELSE ' Active' END",
        "SK_DPD": "dpd",
        "SK_DPD_DEF": "CASE WHEN (k*m)%2=0 THEN dpd ELSE 0 END",
    },
    CARD: {
        "SK_ID_PREV": "e",
        "SK_ID_CURR": "CASE WHEN e%999=0 THEN NULL ELSE u*10 END",
        "MONTHS_BALANCE": "-(e%96)",
        "AMT_BALANCE": "v*(1+u%7)-5e0",
        "AMT_CREDIT_LIMIT_ACTUAL": "CASE WHEN e%40=0 THEN 0e0 ELSE 50e0*(1+u%10) END",
        "AMT_DRAWINGS_ATM_CURRENT": "v*0.2e0",
        "AMT_DRAWINGS_CURRENT": "v-1e0",
        "AMT_DRAWINGS_OTHER_CURRENT": "0",
        "AMT_DRAWINGS_POS_CURRENT": "v*0.8e0",
        "AMT_INST_MIN_REGULAR": "CASE WHEN e%5=0 THEN 0e0 WHEN e%101=0 THEN -1e0 ELSE 20e0 END",
        "AMT_PAYMENT_CURRENT": "v*0.5e0",
        "AMT_PAYMENT_TOTAL_CURRENT": "CASE WHEN e%18=0 THEN 1e0 WHEN e%103=0 THEN -1e0 ELSE 100e0 END",
        "AMT_RECEIVABLE_PRINCIPAL": "v*0.9e0",
        "AMT_RECIVABLE": "v",
        "AMT_TOTAL_RECEIVABLE": "v",
        "CNT_DRAWINGS_ATM_CURRENT": "e%4",
        "CNT_DRAWINGS_CURRENT": "CASE WHEN e%6=0 THEN NULL ELSE e%9 END",
        "CNT_DRAWINGS_OTHER_CURRENT": "0",
        "CNT_DRAWINGS_POS_CURRENT": "e%5",
        "CNT_INSTALMENT_MATURE_CUM": "e%30",
        "SK_DPD": "e%3-1",
        "SK_DPD_DEF": "e%3-1",
    },
}


# Columns read from the test tables. Given to the reader, so that planning does not open any file.
_TABLES = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_discount DOUBLE",
    "events": "event_id BIGINT, user_id BIGINT, value DOUBLE",
}
_ORDER = ("o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS st", "o_totalprice AS tp", "o_orderpriority AS pr")


def _copies(rows: DataFrame, **extra: str) -> DataFrame:
    """Each row once as ``main`` and once more under every name whose condition holds; one scan for all of them."""
    names = ", ".join(f"'{name}'" for name in ("main", *extra))
    wanted = " OR ".join(["copy = 'main'", *(f"copy = '{name}' AND {condition}" for name, condition in extra.items())])
    return rows.selectExpr("*", f"explode(array({names})) AS copy").filter(wanted)


def _application(table: Callable[[str], DataFrame]) -> DataFrame:
    rows = table("customer").selectExpr("c_custkey AS k", "c_acctbal AS ab", "c_nationkey AS nk",
                                        "c_mktsegment AS seg")
    return _copies(rows, twin="k % 50 = 0", no_key="k % 100 = 1").selectExpr(
        "*", "CASE WHEN copy <> 'no_key' THEN k END AS id")


def _bureau(table: Callable[[str], DataFrame]) -> DataFrame:
    rows = table("orders").filter("o_custkey % 20 <> 0").selectExpr(*_ORDER)
    return _copies(rows, older="k % 30 = 0", no_key="k % 211 = 0").selectExpr(
        "k", "st", "pr",
        "CASE WHEN k % 97 = 0 THEN c + 100000000 ELSE c END AS c",
        "CASE WHEN copy <> 'no_key' THEN k END AS bid",
        "CASE WHEN copy = 'older' THEN tp * 0.5e0 ELSE tp END AS tp",
        "CASE WHEN copy = 'older' THEN -(k % 400) - 1000 WHEN copy = 'no_key' THEN -1 "
        "WHEN k % 150 <> 0 THEN -(k % 400) END AS u")


def _previous(table: Callable[[str], DataFrame]) -> DataFrame:
    return _copies(table("orders").selectExpr(*_ORDER), older="k % 40 = 0", no_key="k % 499 = 3").selectExpr(
        "k", "c", "st", "tp", "pr",
        "CASE WHEN copy <> 'no_key' THEN k END AS pid",
        "CASE WHEN copy = 'older' THEN -(k % 900) - 1000 WHEN copy = 'no_key' THEN -1 "
        "WHEN k % 80 <> 0 THEN -(k % 900) END AS d",
        "CASE WHEN copy = 'older' THEN 1 ELSE 0 END AS ver")


def _installments(table: Callable[[str], DataFrame]) -> DataFrame:
    owners = table("orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    lines = table("lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS ln", "l_partkey AS pk",
                                         "l_quantity AS qty", "l_extendedprice AS ep", "l_discount AS dc")
    return lines.join(owners, "k")


def _pos(table: Callable[[str], DataFrame]) -> DataFrame:
    return (table("orders").filter("o_orderkey % 4 > 0")
            .selectExpr("o_orderkey AS k", "o_custkey AS c", "explode(sequence(1, int(o_orderkey % 4))) AS m")
            .selectExpr("*", "CASE WHEN (k * m) % 29 = 0 THEN k % 150 - 5 ELSE 0 END AS dpd"))


def _card(table: Callable[[str], DataFrame]) -> DataFrame:
    return table("events").selectExpr("event_id AS e", "user_id AS u", "value AS v")


_BASES = {APPLICATION: _application, BUREAU: _bureau, PREVIOUS: _previous,
          INSTALLMENTS: _installments, POS: _pos, CARD: _card}


def fixture_casts(table: str) -> list[str]:
    """``CAST(expression AS type) AS column`` for every raw column."""
    types = raw_types(table)
    return [f"CAST({expression} AS {types[column]}) AS {column}"
            for column, expression in FIXTURE_COLUMNS[table].items()]


def fixture_table(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """One raw table, derived lazily from the Parquet files in ``directory``."""
    base = _BASES[table](lambda name: spark.read.schema(_TABLES[name]).parquet(f"{directory}/{name}.parquet"))
    return base.selectExpr(*fixture_casts(table))
