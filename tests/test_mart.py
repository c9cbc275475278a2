import pytest
from conftest import dicts
from pyspark.sql import functions as F

from loanloom.plans import features, mart, scoring
from loanloom.sources.schemas import APPLICATION, BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS

INSTALMENT = ("SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_NUMBER int, DAYS_LATE double, IS_LATE_PAYMENT int, "
              "AMT_INSTALMENT double, AMT_PAYMENT double")
MONTH = "SK_ID_CURR long, SK_ID_PREV long, SK_DPD_DEF int, IS_DELINQUENT int"


def literal_fact(installments, pos):
    """Every instalment paired with every month of its loan, then aggregated."""
    pairs = installments.join(pos, ["SK_ID_CURR", "SK_ID_PREV"], "left")
    late = F.when(F.col("DAYS_LATE") > 0, F.col("DAYS_LATE"))
    return pairs.groupBy(F.col("SK_ID_CURR").alias("CUSTOMER_ID"), F.col("SK_ID_PREV").alias("PREV_LOAN_ID")).agg(
        F.count("NUM_INSTALMENT_NUMBER").alias("TOTAL_INSTALLMENTS"),
        F.sum("IS_LATE_PAYMENT").alias("LATE_PAYMENTS"),
        F.round(F.sum("IS_LATE_PAYMENT") * 100 / F.count(F.lit(1)), 4).alias("MISSED_PAYMENT_RATIO"),
        F.round(F.avg(late), 2).alias("AVG_DAYS_LATE"),
        F.max(late).alias("MAX_DAYS_LATE"),
        F.round(F.sum(F.coalesce("AMT_INSTALMENT", F.lit(0.0))), 4).alias("TOTAL_SCHEDULED"),
        F.round(F.sum(F.coalesce("AMT_PAYMENT", F.lit(0.0))), 4).alias("TOTAL_PAID"),
        F.max(F.coalesce("SK_DPD_DEF", F.lit(0))).alias("MAX_DPD"),
        F.sum(F.coalesce("IS_DELINQUENT", F.lit(0))).alias("DELINQUENT_MONTHS"))


def assert_same_loans(actual, expected):
    expected = {(r["CUSTOMER_ID"], r["PREV_LOAN_ID"]): r for r in dicts(expected)}
    actual = {(r["CUSTOMER_ID"], r["PREV_LOAN_ID"]): r for r in dicts(actual)}
    assert actual.keys() == expected.keys()
    for key, row in expected.items():
        for column, value in row.items():
            assert actual[key][column] == pytest.approx(value, abs=1.1e-4), (key, column)


def test_multiplied_totals_equal_the_literal_join(portfolio):
    installments, pos = portfolio.cleaned(INSTALLMENTS), portfolio.cleaned(POS)
    assert_same_loans(mart.fact_payment_history(installments, pos), literal_fact(installments, pos))


def test_literal_join_equality_with_a_hot_loan(spark):
    installments = spark.createDataFrame(
        [(1, 1, i, float(i % 5 - 2), int(i % 5 > 2), 10.0 + i, 9.5) for i in range(300)]
        + [(c, 10 + c, 1, None, 0, None, None) for c in range(2, 300)], INSTALMENT)
    pos = spark.createDataFrame([(1, 1, i % 100, i % 2) for i in range(150)] + [(5, 15, None, 1), (999, 1, 7, 1)], MONTH)
    assert_same_loans(mart.fact_payment_history(installments, pos), literal_fact(installments, pos))


def test_payment_fact_edges(spark):
    installments = spark.createDataFrame([
        (1, 1, 1, 3.0, 1, 100.0, 90.0), (1, 1, None, -1.0, 0, 100.0, 100.0),
        (2, 2, 1, None, 0, None, None),
        (3, 3, 1, 0.0, 0, 50.0, 50.0)], INSTALMENT)
    pos = spark.createDataFrame([(1, 1, 5, 1), (1, 1, 40, 1), (1, 1, 0, 0), (4, 4, 9, 1)], MONTH)
    fact = {r["CUSTOMER_ID"]: r for r in dicts(mart.fact_payment_history(installments, pos))}
    assert set(fact) == {1, 2, 3}
    assert fact[1] == {
        "CUSTOMER_ID": 1, "PREV_LOAN_ID": 1, "TOTAL_INSTALLMENTS": 3, "LATE_PAYMENTS": 3,
        "MISSED_PAYMENT_RATIO": 50.0, "AVG_DAYS_LATE": 3.0, "MAX_DAYS_LATE": 3.0, "TOTAL_SCHEDULED": 600.0,
        "TOTAL_PAID": 570.0, "PAYMENT_RATIO_PCT": 95.0, "MAX_DPD": 40, "DELINQUENT_MONTHS": 4}
    assert fact[2]["PAYMENT_RATIO_PCT"] is None and fact[2]["TOTAL_SCHEDULED"] == 0.0
    assert fact[2]["AVG_DAYS_LATE"] is None and fact[2]["MAX_DPD"] == 0 and fact[2]["DELINQUENT_MONTHS"] == 0
    true = {r["CUSTOMER_ID"]: r for r in dicts(mart.fact_payment_history(installments, pos, inflate=False))}
    assert (true[1]["TOTAL_INSTALLMENTS"], true[1]["LATE_PAYMENTS"], true[1]["DELINQUENT_MONTHS"]) == (1, 1, 2)
    assert (true[1]["TOTAL_SCHEDULED"], true[1]["TOTAL_PAID"]) == (200.0, 190.0)


def test_loan_ratios(spark):
    application = spark.createDataFrame(
        [(1, "Cash", 300.0, 30.0, 250.0, 90.0), (2, "Cash", 300.0, 30.0, 250.0, None), (3, "Cash", None, 30.0, 0.0, 9.0)],
        "SK_ID_CURR long, NAME_CONTRACT_TYPE string, AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double, "
        "AMT_INCOME_TOTAL double")
    previous = spark.createDataFrame([(1, "APPROVED"), (1, "REFUSED"), (1, "CANCELED"), (1, "UNUSED OFFER")],
                                     "SK_ID_CURR long, NAME_CONTRACT_STATUS string")
    loans = {r["CUSTOMER_ID"]: r for r in dicts(mart.dim_loan(application, previous))}
    assert (loans[1]["DEBT_TO_INCOME_RATIO"], loans[1]["DTI_PCT"], loans[1]["LOAN_BURDEN_SCORE"]) == (
        3.3333, 333.3333, 4.0)
    assert [loans[1][c] for c in mart.PREVIOUS_COUNTS] == [4, 1, 1, 1]
    assert loans[2]["DTI_PCT"] is None and loans[2]["LOAN_BURDEN_SCORE"] is None
    assert loans[3]["DTI_PCT"] is None and loans[3]["LOAN_BURDEN_SCORE"] == 40.0
    assert [loans[2][c] for c in mart.PREVIOUS_COUNTS] == [0, 0, 0, 0]


def test_card_history(spark):
    application = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 1.0)],
                                        "SK_ID_CURR long, TARGET int, AMT_CREDIT double, AMT_INCOME_TOTAL double, "
                                        "AMT_ANNUITY double")
    card = spark.createDataFrame([(1, 0.5, 1, 10.0, 100.0, 3), (1, None, 0, None, None, None), (7, 0.1, 1, 1.0, 1.0, 1)],
                                 "SK_ID_CURR long, MONTHLY_CREDIT_UTILIZATION double, IS_BELOW_MIN_PAYMENT int, "
                                 "AMT_DRAWINGS_CURRENT double, AMT_BALANCE double, SK_DPD_DEF int")
    one, two = sorted(dicts(mart.fact_loan_performance(application, card)), key=lambda r: r["CUSTOMER_ID"])
    assert one["AVG_CREDIT_UTILIZATION_PCT"] == 50.0 and one["AVG_CC_BALANCE"] == 50.0 and one["MAX_CC_DPD"] == 3
    assert two["AVG_CREDIT_UTILIZATION_PCT"] is None
    assert [two[c] for c in mart.CARD_TOTALS] == [0, 0.0, 0.0, 0]


def test_customer_without_history(raw_rows):
    from loanloom.plans import cleaning
    application = cleaning.clean_application(raw_rows(APPLICATION, {"SK_ID_CURR": 1, "TARGET": 0}))
    empty = {t: cleaning.CLEANERS[t](raw_rows(t).limit(0)) for t in (BUREAU, PREVIOUS, INSTALLMENTS, POS, CARD)}
    row, = dicts(features.customer_risk_features(
        application, empty[PREVIOUS], mart.dim_credit_history(empty[BUREAU]),
        mart.fact_payment_history(empty[INSTALLMENTS], empty[POS]), empty[CARD]))
    assert row["PAYMENT_RATIO_PCT"] == 100.0 and row["AVG_CREDIT_UTILIZATION_PCT"] == 0.0
    assert row["DTI_PCT"] is None and row["DTI_CATEGORY"] == "Low DTI" and row["AGE_BAND"] == "55+"
    history = ["TOTAL_PREV_APPLICATIONS", "TOTAL_BUREAU_RECORDS", "TOTAL_DEBT", "MAX_OVERDUE", "MISSED_PAYMENT_RATIO",
               "MAX_DAYS_LATE", "DELINQUENT_MONTHS", "MAX_CC_DPD", "AVG_CC_BALANCE"]
    assert [row[c] for c in history] == [0] * len(history)
    score, = dicts(scoring.customer_risk_scores(features_of(row, application.sparkSession)))
    assert (score["RISK_SCORE"], score["RISK_CATEGORY"], score["HIGH_RISK_EXPOSURE"]) == (20, "Low Risk", 0.0)


def features_of(row, spark):
    types = {"CUSTOMER_ID": "long", "PREV_DEFAULT_COUNT": "long", "PREV_REFUSED": "long", "MAX_DPD": "int",
             "DELINQUENT_MONTHS": "long", "DEFAULT_FLAG": "int"}
    numeric = ("DTI", "MISSED", "AVG", "YEARS", "LOAN", "TOTAL", "PAYMENT", "MAX", "ANNUAL", "AGE", "REGION")
    kept = {c: row.get(c) for c in scoring._FEATURES_KEPT}
    kind = {c: types.get(c) or ("string" if c.endswith(("BAND", "CATEGORY")) or not c.startswith(numeric) else "double")
            for c in kept}
    values = tuple(float(v) if kind[c] == "double" and v is not None else v for c, v in kept.items())
    return spark.createDataFrame([values], ", ".join(f"{c} {kind[c]}" for c in kept))


def test_star_schema_and_direct_features_agree(portfolio):
    star = features.features_from_star(portfolio.dim_customer, portfolio.dim_loan, portfolio.dim_credit_history,
                                       portfolio.fact_payment_history, portfolio.fact_loan_performance)
    direct = portfolio.customer_risk_features
    assert star.columns == direct.columns and len(direct.columns) == 43
    assert star.dtypes == direct.dtypes
    assert star.exceptAll(direct).count() == 0 and direct.exceptAll(star).count() == 0


@pytest.mark.parametrize("rule, cases", [
    ("PTS_DTI", {300.01: 30, 300.0: 15, 150.0: 15, 149.99: 0, None: 0}),
    ("PTS_PREV_DEFAULT", {0.0: 0, 1.0: 25, 7.0: 25}),
    ("PTS_EMPLOYMENT", {None: 20, 1.99: 20, 2.0: 0}),
    ("PTS_UTILIZATION", {80.01: 15, 80.0: 8, 50.0: 8, 49.99: 0, -3.0: 0}),
    ("PTS_MISSED_PAYMENTS", {20.01: 10, 20.0: 5, 10.0: 5, 9.99: 0}),
    ("PTS_REFUSALS", {0.0: 0, 1.0: 5, 2.0: 10, 9.0: 10, None: 0}),
    ("PTS_MAX_DPD", {90.0: 5, 91.0: 10, 30.0: 5, 29.0: 0}),
    ("PTS_DELINQUENCY", {5.0: 0, 6.0: 5}),
])
def test_points(spark, rule, cases):
    rule = next(r for r in scoring.RULES if r.points == rule)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], f"i int, {rule.feature} double")
    assert [r[0] for r in rows.orderBy("i").select(rule.column()).collect()] == list(cases.values())


def test_categories(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 30, 31, 60, 61, 125)], "s int")
    assert [r[0] for r in rows.select(scoring.risk_category(F.col("s"))).collect()] == [
        "Low Risk", "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk"]


def test_scores_add_up(portfolio):
    points = {r["CUSTOMER_ID"]: sum(v for k, v in r.items() if k.startswith("PTS"))
              for r in dicts(scoring.risk_points(portfolio.customer_risk_features))}
    scores = dicts(portfolio.customer_risk_scores)
    assert {r["CUSTOMER_ID"]: r["RISK_SCORE"] for r in scores} == points
    assert all(0 <= s <= 125 for s in points.values())
    assert len(scores[0]) == 33
    for row in scores:
        assert row["HIGH_RISK_EXPOSURE"] == (row["LOAN_AMOUNT"] if row["RISK_CATEGORY"] == "High Risk" else 0.0)


def test_left_joins_keep_every_customer(portfolio):
    customers = portfolio.cleaned(APPLICATION).count()
    for table in (portfolio.dim_loan, portfolio.fact_loan_performance, portfolio.customer_risk_features):
        assert table.select("CUSTOMER_ID").distinct().count() == table.count() == customers
    assert portfolio.cleaned(PREVIOUS).select("SK_ID_PREV").distinct().count() == portfolio.cleaned(PREVIOUS).count()
