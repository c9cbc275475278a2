"""Shape of the physical plans: what has to hold for them to work on large data."""

import re

import pytest
from conftest import TESTDATA, plan_of

import __spark_entry__ as entry
from loanloom import Portfolio
from loanloom.plans import reports
from loanloom.sources.fixtures import fixture_table
from loanloom.sources.schemas import RAW_TABLES


@pytest.fixture(scope="module")
def no_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.fixture(scope="module")
def raw_files(spark, tmp_path_factory):
    """A portfolio over raw Parquet files, as a load leaves them."""
    root = tmp_path_factory.mktemp("raw")
    for table in RAW_TABLES:
        fixture_table(spark, f"{TESTDATA}/sf0.001", table).write.parquet(f"{root}/{table}")
    return Portfolio(lambda table: spark.read.parquet(f"{root}/{table}"))


@pytest.mark.parametrize("name", sorted(entry.portfolio_queries()))
def test_no_query_pairs_or_interprets_rows(spark, no_broadcast, name):
    plan = plan_of(entry.queries()[name](spark, f"{TESTDATA}/sf0.001"))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "SortAggregate",
                     "ObjectHashAggregate", "Python", "Pandas"):
        assert operator not in plan
    # Only aggregated groups pass through a single partition.
    for match in re.finditer(r"Exchange SinglePartition", plan):
        assert "HashAggregate" in plan[match.end():].split("\n")[1]


def test_scores_shuffle_once_per_step(raw_files, no_broadcast):
    plan = plan_of(raw_files.customer_risk_scores)
    keys = re.findall(r"Exchange hashpartitioning\((.*?), 4\)", plan)
    keys = sorted(re.sub(r"#\d+L?", "", key) for key in keys)
    # Deduplication of three tables, then one shuffle of partial totals per side; no join shuffles again.
    assert keys == sorted(["SK_ID_CURR", "SK_ID_PREV", "SK_ID_BUREAU", "SK_ID_CURR", "SK_ID_CURR",
                           "SK_ID_CURR, SK_ID_PREV", "CUSTOMER_ID", "SK_ID_CURR"])
    assert plan.count("SortMergeJoin") == 4


def test_null_keys_are_dropped_by_the_reader(raw_files):
    for table in RAW_TABLES:
        assert re.search(r"PushedFilters: \[[^]]*IsNotNull\(SK_ID_CURR\)", plan_of(raw_files.cleaned(table)))


def test_scans_read_only_what_is_needed(raw_files):
    plan = plan_of(reports.late_payment_rate(raw_files.cleaned("installments_payments")))
    schema, = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert {column.split(":")[0] for column in schema.split(",")} == {
        "SK_ID_CURR", "SK_ID_PREV", "AMT_INSTALMENT", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"}


@pytest.mark.parametrize("name, columns", [
    ("status_distribution", {"SK_ID_CURR", "SK_ID_PREV", "DAYS_DECISION", "NAME_CONTRACT_STATUS"}),
    ("default_by_dti", {"SK_ID_CURR", "TARGET", "AMT_CREDIT", "AMT_INCOME_TOTAL"}),
    ("bureau_minima", {"SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT_UPDATE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT",
                       "AMT_CREDIT_MAX_OVERDUE"})])
def test_deduplication_reads_only_what_is_needed(raw_files, name, columns):
    plan = plan_of({"status_distribution": lambda p: reports.status_distribution(p.cleaned("previous_application")),
                    "default_by_dti": lambda p: reports.default_by_dti(p.customer_risk_features),
                    "bureau_minima": lambda p: reports.bureau_minima(p.cleaned("bureau"))}[name](raw_files))
    schema, = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    # The number of a row in its file is made by the reader.
    assert {column.split(":")[0] for column in schema.split(",")} - {"_tmp_metadata_row_index"} == columns
    assert "WindowGroupLimit" in plan


def test_reports_skip_the_joins_they_do_not_need(raw_files):
    for report in (reports.default_by_dti, reports.default_by_employment):
        plan = plan_of(report(raw_files.customer_risk_features))
        assert "Join" not in plan and plan.count("FileScan") == 1
    plan = plan_of(reports.risk_by_income(raw_files.customer_risk_scores))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_top_list_does_not_sort_everything(raw_files):
    assert "TakeOrderedAndProject" in plan_of(reports.top_high_risk(raw_files.customer_risk_scores))
