"""The six raw tables. Column names, order and types are fixed values of the data set."""

from __future__ import annotations

APPLICATION = "application_train"
BUREAU = "bureau"
PREVIOUS = "previous_application"
INSTALLMENTS = "installments_payments"
POS = "pos_cash_balance"
CARD = "credit_card_balance"

RAW_DDL = {
    APPLICATION: """
        SK_ID_CURR BIGINT, TARGET INT, NAME_CONTRACT_TYPE STRING, CODE_GENDER STRING, FLAG_OWN_CAR STRING,
        FLAG_OWN_REALTY STRING, CNT_CHILDREN INT, AMT_INCOME_TOTAL DOUBLE, AMT_CREDIT DOUBLE, AMT_ANNUITY DOUBLE,
        AMT_GOODS_PRICE DOUBLE, NAME_TYPE_SUITE STRING, NAME_INCOME_TYPE STRING, NAME_EDUCATION_TYPE STRING,
        NAME_FAMILY_STATUS STRING, NAME_HOUSING_TYPE STRING, DAYS_BIRTH INT, DAYS_EMPLOYED INT,
        OCCUPATION_TYPE STRING, CNT_FAM_MEMBERS DOUBLE, REGION_RATING_CLIENT INT, ORGANIZATION_TYPE STRING""",
    BUREAU: """
        SK_ID_BUREAU BIGINT, SK_ID_CURR BIGINT, CREDIT_ACTIVE STRING, CREDIT_CURRENCY STRING, DAYS_CREDIT INT,
        CREDIT_DAY_OVERDUE INT, DAYS_CREDIT_ENDDATE DOUBLE, DAYS_ENDDATE_FACT DOUBLE, AMT_CREDIT_MAX_OVERDUE DOUBLE,
        CNT_CREDIT_PROLONG INT, AMT_CREDIT_SUM DOUBLE, AMT_CREDIT_SUM_DEBT DOUBLE, AMT_CREDIT_SUM_LIMIT DOUBLE,
        AMT_CREDIT_SUM_OVERDUE DOUBLE, CREDIT_TYPE STRING, DAYS_CREDIT_UPDATE INT, AMT_ANNUITY DOUBLE""",
    PREVIOUS: """
        SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, NAME_CONTRACT_TYPE STRING, AMT_ANNUITY DOUBLE, AMT_APPLICATION DOUBLE,
        AMT_CREDIT DOUBLE, AMT_DOWN_PAYMENT DOUBLE, AMT_GOODS_PRICE DOUBLE, NAME_CONTRACT_STATUS STRING,
        DAYS_DECISION INT, NAME_PAYMENT_TYPE STRING, CODE_REJECT_REASON STRING, NAME_CLIENT_TYPE STRING,
        NAME_PRODUCT_TYPE STRING, DAYS_FIRST_DUE DOUBLE, DAYS_LAST_DUE DOUBLE, CNT_PAYMENT DOUBLE""",
    INSTALLMENTS: """
        SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, NUM_INSTALMENT_VERSION DOUBLE, NUM_INSTALMENT_NUMBER INT,
        DAYS_INSTALMENT DOUBLE, DAYS_ENTRY_PAYMENT DOUBLE, AMT_INSTALMENT DOUBLE, AMT_PAYMENT DOUBLE""",
    POS: """
        SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, MONTHS_BALANCE INT, CNT_INSTALMENT DOUBLE,
        CNT_INSTALMENT_FUTURE DOUBLE, NAME_CONTRACT_STATUS STRING, SK_DPD INT, SK_DPD_DEF INT""",
    CARD: """
        SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, MONTHS_BALANCE INT, AMT_BALANCE DOUBLE, AMT_CREDIT_LIMIT_ACTUAL DOUBLE,
        AMT_DRAWINGS_ATM_CURRENT DOUBLE, AMT_DRAWINGS_CURRENT DOUBLE, AMT_DRAWINGS_OTHER_CURRENT DOUBLE,
        AMT_DRAWINGS_POS_CURRENT DOUBLE, AMT_INST_MIN_REGULAR DOUBLE, AMT_PAYMENT_CURRENT DOUBLE,
        AMT_PAYMENT_TOTAL_CURRENT DOUBLE, AMT_RECEIVABLE_PRINCIPAL DOUBLE, AMT_RECIVABLE DOUBLE,
        AMT_TOTAL_RECEIVABLE DOUBLE, CNT_DRAWINGS_ATM_CURRENT DOUBLE, CNT_DRAWINGS_CURRENT INT,
        CNT_DRAWINGS_OTHER_CURRENT DOUBLE, CNT_DRAWINGS_POS_CURRENT DOUBLE, CNT_INSTALMENT_MATURE_CUM DOUBLE,
        SK_DPD INT, SK_DPD_DEF INT""",
}

RAW_TABLES = tuple(RAW_DDL)


def raw_types(table: str) -> dict[str, str]:
    """Type name of each column of a raw table, in order."""
    return dict(column.split() for column in RAW_DDL[table].split(","))
