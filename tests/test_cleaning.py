from conftest import dicts, plan_of
from pyspark.sql import functions as F

from loanloom.operators.dedup import first_per_key, latest_per_key, row_locator
from loanloom.plans import cleaning
from loanloom.sources.schemas import APPLICATION, BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS


def test_application(raw_rows):
    rows = raw_rows(
        APPLICATION,
        {"SK_ID_CURR": 1, "CODE_GENDER": " f", "NAME_CONTRACT_TYPE": " Cash ", "AMT_INCOME_TOTAL": -5.0,
         "AMT_CREDIT": 0.0, "DAYS_BIRTH": -7300, "DAYS_EMPLOYED": 365243},
        {"SK_ID_CURR": 2, "AMT_INCOME_TOTAL": 10.0, "AMT_CREDIT": 20.0, "DAYS_EMPLOYED": -365,
         "OCCUPATION_TYPE": "Cook", "ORGANIZATION_TYPE": "Org"},
        {"SK_ID_CURR": None, "AMT_CREDIT": 1.0})
    one, two = sorted(dicts(cleaning.clean_application(rows)), key=lambda r: r["SK_ID_CURR"])
    assert one["CODE_GENDER"] == "F" and one["NAME_CONTRACT_TYPE"] == " Cash "
    assert one["AMT_INCOME_TOTAL"] is None and one["AMT_CREDIT"] is None
    assert one["AGE_YEARS"] == 20.0 and one["YEARS_EMPLOYED"] is None
    assert one["OCCUPATION_TYPE"] == one["ORGANIZATION_TYPE"] == "Unknown"
    assert two["AGE_YEARS"] is None and two["YEARS_EMPLOYED"] == 1.0 and two["OCCUPATION_TYPE"] == "Cook"
    assert len(one) == 22


def test_bureau_and_previous_amounts(raw_rows):
    bureau, = dicts(cleaning.clean_bureau(raw_rows(BUREAU, {
        "SK_ID_BUREAU": 1, "SK_ID_CURR": 1, "CREDIT_ACTIVE": " closed", "AMT_CREDIT_SUM": -1.0,
        "AMT_CREDIT_SUM_DEBT": 0.0})))
    assert bureau["CREDIT_ACTIVE"] == "CLOSED" and bureau["AMT_CREDIT_SUM"] is None
    assert bureau["AMT_CREDIT_SUM_DEBT"] == 0.0
    assert bureau["AMT_CREDIT_SUM_OVERDUE"] == bureau["AMT_ANNUITY"] == 0.0
    previous, = dicts(cleaning.clean_previous(raw_rows(PREVIOUS, {
        "SK_ID_PREV": 1, "SK_ID_CURR": 1, "AMT_APPLICATION": 0.0, "AMT_GOODS_PRICE": -1.0, "AMT_CREDIT": 0.0,
        "AMT_ANNUITY": -0.1, "CNT_PAYMENT": -2.0, "NAME_CONTRACT_STATUS": "Unused offer "})))
    assert previous["AMT_APPLICATION"] is None and previous["AMT_GOODS_PRICE"] is None
    assert previous["AMT_CREDIT"] == 0.0 and previous["AMT_ANNUITY"] is None and previous["CNT_PAYMENT"] is None
    assert previous["NAME_CONTRACT_STATUS"] == "UNUSED OFFER"
    assert previous["NAME_PAYMENT_TYPE"] == previous["CODE_REJECT_REASON"] == "Unknown"


def test_installments(raw_rows):
    key = {"SK_ID_PREV": 1, "SK_ID_CURR": 1}
    rows = cleaning.clean_installments(raw_rows(
        INSTALLMENTS,
        {**key, "NUM_INSTALMENT_NUMBER": 1, "DAYS_INSTALMENT": -10.0, "DAYS_ENTRY_PAYMENT": -8.0, "AMT_INSTALMENT": 5.0},
        {**key, "NUM_INSTALMENT_NUMBER": 2, "DAYS_INSTALMENT": -10.0, "DAYS_ENTRY_PAYMENT": None, "AMT_INSTALMENT": -5.0},
        {**key, "NUM_INSTALMENT_NUMBER": 3, "DAYS_INSTALMENT": -10.0, "DAYS_ENTRY_PAYMENT": -10.0, "AMT_INSTALMENT": 1.0},
        {**key, "NUM_INSTALMENT_NUMBER": 4, "AMT_INSTALMENT": None}))
    by_number = {r["NUM_INSTALMENT_NUMBER"]: r for r in dicts(rows)}
    assert set(by_number) == {1, 2, 3}
    assert (by_number[1]["DAYS_LATE"], by_number[1]["IS_LATE_PAYMENT"]) == (2.0, 1)
    assert (by_number[2]["DAYS_LATE"], by_number[2]["IS_LATE_PAYMENT"]) == (None, 0)
    assert by_number[2]["AMT_INSTALMENT"] is None
    assert by_number[3]["IS_LATE_PAYMENT"] == 0


def test_pos_days_past_due(raw_rows):
    key = {"SK_ID_PREV": 1, "SK_ID_CURR": 1}
    rows = dicts(cleaning.clean_pos(raw_rows(POS, *[
        {**key, "MONTHS_BALANCE": -i, "SK_DPD": d, "SK_DPD_DEF": d, "CNT_INSTALMENT": float(i - 2)}
        for i, d in enumerate([-3, 0, 4, None])], {"SK_ID_PREV": None, "SK_ID_CURR": 1})))
    assert [(r["SK_DPD"], r["SK_DPD_DEF"], r["IS_DELINQUENT"]) for r in rows] == [
        (0, 0, 0), (0, 0, 0), (4, 4, 1), (None, None, 0)]
    assert [r["CNT_INSTALMENT"] for r in rows] == [None, None, 0.0, 1.0]


def test_card_reads_raw_values(raw_rows):
    key = {"SK_ID_PREV": 1, "SK_ID_CURR": 1}
    rows = dicts(cleaning.clean_card(raw_rows(
        CARD,
        {**key, "AMT_BALANCE": -10.0, "AMT_CREDIT_LIMIT_ACTUAL": 300.0, "AMT_INST_MIN_REGULAR": 5.0,
         "AMT_PAYMENT_TOTAL_CURRENT": -1.0},
        {**key, "AMT_BALANCE": 50.0, "AMT_CREDIT_LIMIT_ACTUAL": 0.0, "AMT_INST_MIN_REGULAR": 0.0,
         "AMT_PAYMENT_TOTAL_CURRENT": -1.0},
        {**key, "AMT_CREDIT_LIMIT_ACTUAL": 100.0, "AMT_INST_MIN_REGULAR": 5.0, "AMT_PAYMENT_TOTAL_CURRENT": 5.0,
         "CNT_DRAWINGS_CURRENT": 4})))
    assert [r["AMT_BALANCE"] for r in rows] == [None, 50.0, None]
    assert [r["MONTHLY_CREDIT_UTILIZATION"] for r in rows] == [-0.0333, None, None]
    assert [r["AMT_PAYMENT_TOTAL_CURRENT"] for r in rows] == [None, None, 5.0]
    assert [r["IS_BELOW_MIN_PAYMENT"] for r in rows] == [1, 0, 0]
    assert [r["CNT_DRAWINGS_CURRENT"] for r in rows] == [0, 0, 4]
    assert len(rows[0]) == 13


def test_missing_recency_wins(spark):
    rows = spark.createDataFrame([(1, -5, "old"), (1, -1, "new"), (2, -1, "dated"), (2, None, "undated")],
                                 "k bigint, d int, tag string")
    assert {r.k: r.tag for r in latest_per_key(rows, "k", "d").collect()} == {1: "new", 2: "undated"}


def test_ties_are_settled_by_content(spark):
    rows = spark.range(3000).select((F.col("id") % 100).alias("k"), F.lit(1).alias("d"), F.col("id").alias("v"))
    results = [sorted(latest_per_key(rows.repartition(n, *by), "k", "d").collect())
               for n, by in ((1, ()), (5, ("v",)), (8, ("d",)))]
    assert results[0] == results[1] == results[2] and len(results[0]) == 100


def test_ties_are_settled_by_place_in_the_files(spark, tmp_path):
    """Whatever the splits, the shuffle and the columns that are read: the first row in the files' order of locators."""
    spark.range(6000).select((F.col("id") % 100).alias("k"), F.lit(1).alias("d"), F.col("id").alias("v")).repartition(
        3).write.parquet(f"{tmp_path}/rows")
    results, settings = [], {"spark.sql.files.maxPartitionBytes": ("128m", "4k", "16k"), "spark.sql.shuffle.partitions": ("1", "7", "3")}
    before = {key: spark.conf.get(key) for key in settings}
    for i in range(3):
        for key, values in settings.items():
            spark.conf.set(key, values[i])
        results.append(sorted(latest_per_key(spark.read.parquet(f"{tmp_path}/rows"), "k", "d").collect()))
    for key, value in before.items():
        spark.conf.set(key, value)
    assert results[0] == results[1] == results[2] and len(results[0]) == 100
    # The same rows survive if only the key is read.
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted(r.k for r in latest_per_key(rows, "k", "d").select("k").collect()) == list(range(100))
    assert "v#" not in plan_of(latest_per_key(rows, "k", "d").select("k"))


def test_only_rows_of_files_have_a_locator(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/rows")
    spark.range(10).write.csv(f"{tmp_path}/text")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    for plan in (rows, rows.filter("k > 0"), rows.select("k"), rows.withColumn("x", F.lit(1)).filter("x = 1")):
        assert row_locator(plan) is not None
    for plan in (rows.filter("k > 0").alias("r"), rows.distinct(), rows.union(rows), rows.join(rows.withColumnRenamed("id", "i"), "k"), rows.repartition(2),
                 rows.select("k", F.explode(F.array("id", "id"))), spark.read.csv(f"{tmp_path}/text"), spark.range(3)):
        assert row_locator(plan) is None
        first_per_key(plan, plan.columns[0]).collect()


def test_hot_key(spark):
    # A third of the rows share one key.
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
                                      F.col("id").cast("int").alias("d"))
    kept = latest_per_key(rows, "k", "d")
    assert kept.count() == 20_001
    assert kept.filter("k = -1").first().d == 29_997


def test_one_row_per_key_reduces_before_the_shuffle(spark):
    rows = spark.range(10).select((F.col("id") % 5).alias("k"), F.lit("x").alias("s"))
    plan = plan_of(first_per_key(rows, "k"))
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
