import gzip

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from loanloom.__main__ import REPORTS, csv_paths, main
from loanloom.plans.expectations import GENERAL, PUBLISHED, ExpectationError, Range
from loanloom.plans.rebuild import CUSTOMER, build, load_csv, load_raw, rebuild, stored_metrics
from loanloom.plans.reports import row_counts
from loanloom.sources.csv import REJECTED, checked_csv, read_raw_csv
from loanloom.sources.fixtures import fixture_table
from loanloom.sources.layers import ANALYTICS, CLEANED, LAYERS, MOST_BUCKETS, RAW, ROWS_PER_BUCKET, Layers, bucket_count
from loanloom.sources.schemas import INSTALLMENTS, RAW_DDL, RAW_TABLES, raw_types

HEADER = "SK_ID_CURR,extra,SK_ID_PREV,NUM_INSTALMENT_VERSION,NUM_INSTALMENT_NUMBER,DAYS_INSTALMENT," \
         "DAYS_ENTRY_PAYMENT,AMT_PAYMENT,AMT_INSTALMENT"
LINES = ["7,x,100,1.0,3.0,-10,-12.0,5.5,", '8,"a, ""b""",101,2.0,4,-20.0,,,1e2']


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_csv_by_name(spark, tmp_path, suffix):
    path = f"{tmp_path}/rows.csv{suffix}"
    with (gzip.open if suffix else open)(path, "wt") as file:
        file.write("\n".join([HEADER, *LINES]))
    rows = read_raw_csv(spark, path, INSTALLMENTS)
    assert [f"{name} {kind.upper()}" for name, kind in rows.dtypes] == [
        f"{name} {kind}" for name, kind in raw_types(INSTALLMENTS).items()]
    assert sorted(tuple(r) for r in rows.collect()) == [
        (100, 7, 1.0, 3, -10.0, -12.0, None, 5.5), (101, 8, 2.0, 4, -20.0, None, 100.0, None)]
    assert ("REBALANCE" in plan_of(rows).upper()) == bool(suffix)


def test_gzip_is_seen_in_the_files(spark, tmp_path):
    """A folder of one large and several small parts, some of them compressed, and a glob of them."""
    lines, plain = [f"{i},x,{i % 5},1.0,{i % 9},-10,-12.0,5.5,{i}.25" for i in range(4000)], tmp_path / "plain"
    folder = tmp_path / "parts"
    folder.mkdir(), plain.mkdir()
    for i, part in enumerate((lines[:3500], lines[3500:3700], lines[3700:3701], lines[3701:])):
        with (gzip.open(folder / f"p{i}.csv.gz", "wt") if i != 2 else open(folder / f"p{i}.csv", "w")) as file:
            file.write("\n".join([HEADER, *part]))
    (plain / "all.csv").write_text("\n".join([HEADER, *lines]))
    expected = sorted(tuple(r) for r in read_raw_csv(spark, str(plain), INSTALLMENTS).collect())
    assert "REBALANCE" not in plan_of(read_raw_csv(spark, str(plain), INSTALLMENTS)).upper()
    for path, count in ((folder, 4000), (f"{folder}/*.gz", 3999)):
        rows = read_raw_csv(spark, str(path), INSTALLMENTS)
        assert "REBALANCE" in plan_of(rows).upper() and rows.count() == count
    assert sorted(tuple(r) for r in read_raw_csv(spark, str(folder), INSTALLMENTS).collect()) == expected


def damaged(folder, table, lines):
    folder.mkdir(exist_ok=True)
    names = list(raw_types(table))
    (folder / f"{table}.csv").write_text("\n".join([",".join(names), *[",".join(line.get(n, "") for n in names) for line in lines]]))


@pytest.mark.parametrize("compressed", [False, True])
def test_rejects_name_file_row_column_and_text(spark, tmp_path, compressed):
    folder = tmp_path / "parts"
    folder.mkdir()
    good = [f"{i},x,{i % 5},1.0,{i % 9},-10,-12.0,5.5,{i}.25" for i in range(3000)]
    bad = {0: "seven,x,1,1.0,3.0,-10,-12.0,5.5,", 1234: "7,x,1,one,3,-10,-12.0,5.5,2,5", 2999: "7,x,1,1.0,99999999999,-10,,late,1"}
    for part in ("a", "b"):
        lines = [bad.get(i, line) if part == "a" else line for i, line in enumerate(good)]
        with (gzip.open(folder / f"{part}.csv.gz", "wt") if compressed else open(folder / f"{part}.csv", "w")) as file:
            file.write("\n".join([HEADER, *lines]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = checked_csv(spark, str(folder), INSTALLMENTS)
        rejects = sorted((r.file.rpartition("/")[2][0], r.row, r.column, r.text) for r in read.rejects.collect())
        rows = read.rows.where(f"NOT {REJECTED}").drop(REJECTED)
        assert rows.count() == 5997 and read.rows.count() == 6000
        assert rows.dtypes == read_raw_csv(spark, str(folder), INSTALLMENTS).dtypes
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rejects == [("a", 1, "SK_ID_CURR", "seven"), ("a", 1235, "NUM_INSTALMENT_VERSION", "one"),
                       ("a", 3000, "AMT_PAYMENT", "late"), ("a", 3000, "NUM_INSTALMENT_NUMBER", "99999999999")]


def test_load_with_a_limit_of_rejects(spark, tmp_path):
    layers = Layers(spark, str(tmp_path / "layers"), prefix="limited_")
    folder = tmp_path / "csv"
    for table in RAW_TABLES:
        damaged(folder, table, [{"SK_ID_CURR": str(i)} for i in range(5)])
    paths = csv_paths(str(folder), {})
    load_csv(layers, paths, reject_limit=2)
    assert layers.metrics(RAW, "bureau") == {"row_count": 5, "rejected_rows": 0}
    assert layers.table(RAW, "bureau_rejects").count() == 0
    damaged(folder, "bureau", [{"SK_ID_CURR": str(i), "DAYS_CREDIT": "x" if i < 2 else "-3"} for i in range(8)])
    load_csv(layers, paths, reject_limit=2)
    assert layers.metrics(RAW, "bureau") == {"row_count": 6, "rejected_rows": 2}
    assert sorted((r.row, r.column, r.text) for r in layers.table(RAW, "bureau_rejects").collect()) == [
        (1, "DAYS_CREDIT", "x"), (2, "DAYS_CREDIT", "x")]
    damaged(folder, "bureau", [{"SK_ID_CURR": str(i), "DAYS_CREDIT": "y", "AMT_ANNUITY": "z"} for i in range(9)])
    with pytest.raises(ExpectationError, match="raw_data.bureau: rejected_rows is 9, expected .* 2"):
        load_csv(layers, paths, reject_limit=2)
    assert layers.table(RAW, "bureau").count() == 6 and layers.table(RAW, "bureau_rejects").count() == 18
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_csv(layers, paths)
    assert layers.table(RAW, "bureau").count() == 6
    drop(spark, layers)


def test_csv_with_a_missing_column(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("SK_ID_PREV,SK_ID_CURR\n1,2\n")
    with pytest.raises(Exception, match="NUM_INSTALMENT_VERSION"):
        read_raw_csv(spark, str(path), INSTALLMENTS)


def test_csv_with_text_in_a_number(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("\n".join([HEADER, "seven" + LINES[0][1:]]))
    with pytest.raises(Exception, match="seven"):
        read_raw_csv(spark, str(path), INSTALLMENTS).collect()


def test_schemas_have_every_column():
    assert [len(raw_types(table)) for table in RAW_TABLES] == [22, 17, 17, 8, 8, 22]
    assert {kind for table in RAW_TABLES for kind in raw_types(table).values()} == {"BIGINT", "INT", "DOUBLE", "STRING"}
    assert all(len(raw_types(table)) == ddl.count(",") + 1 for table, ddl in RAW_DDL.items())


def drop(spark, layers):
    for layer in LAYERS:
        for name in (layer, f"{layer}_versions"):
            spark.sql(f"DROP DATABASE IF EXISTS {layers.prefix}{name} CASCADE")


def fixtures(spark):
    return lambda table: fixture_table(spark, "/root/testdata/sf0.001", table)


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    made = Layers(spark, str(tmp_path_factory.mktemp("layers")))
    yield made
    drop(spark, made)


@pytest.fixture(scope="module")
def stored(spark, layers):
    return rebuild(layers, fixtures(spark))


def same(one, other):
    assert sorted(one.columns) == sorted(other.columns)
    other = other.select(one.columns)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_rebuild_stores_what_the_lazy_plans_give(stored, portfolio):
    for table in RAW_TABLES:
        same(stored.raw(table), portfolio.raw(table))
        same(stored.cleaned(table), portfolio.cleaned(table))
    for table in ("dim_customer", "dim_loan", "dim_credit_history", "fact_payment_history", "fact_loan_performance",
                  "customer_risk_features", "customer_risk_scores"):
        same(getattr(stored, table), getattr(portfolio, table))


def test_reports_on_stored_tables(stored, portfolio):
    for name, report in REPORTS.items():
        assert report(stored).collect() == report(portfolio).collect(), name


def test_stored_tables_answer_sql(spark, stored):
    rows = spark.sql("SELECT RISK_CATEGORY, count(*) AS n FROM analytics.customer_risk_scores GROUP BY ALL")
    assert sum(r.n for r in rows.collect()) == 150
    assert spark.sql("SELECT count(*) FROM cleaned_data.bureau").first()[0] == 1406
    assert {r.table_name: r.row_count for r in row_counts({"raw": stored.raw("bureau")}).collect()} == {"raw": 1462}


def test_customer_tables_join_without_a_shuffle(spark, stored):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = (stored.dim_customer.join(stored.dim_loan, "CUSTOMER_ID", "left")
                  .join(stored.dim_credit_history, "CUSTOMER_ID", "left")
                  .join(stored.fact_loan_performance, "CUSTOMER_ID", "left"))
        plan = plan_of(joined)
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_replace_replaces(spark, stored, layers):
    for n in (5, 3, 7):
        rows = layers.replace(ANALYTICS, "scratch", spark.range(n), unique_key="id")
        assert rows.count() == n == spark.table("analytics.scratch").count()
        assert layers.metrics(ANALYTICS, "scratch") == {"row_count": n, "repeated_keys": 0, "missing_keys": 0, "buckets": 1}
    # Another schema as well; the version before stays for readers that have planned on it, older ones go.
    before = layers.table(ANALYTICS, "scratch")
    layers.replace(ANALYTICS, "scratch", spark.range(4).selectExpr("id AS other"))
    assert before.count() == 7 and spark.table("analytics.scratch").columns == ["other"]
    assert len(spark.sql("SHOW TABLES IN analytics_versions LIKE 'scratch__*'").collect()) == 2


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, stored, layers):
    layers.replace(ANALYTICS, "broken", spark.range(5))
    before = len(spark.sql("SHOW TABLES IN analytics_versions").collect())
    # One of the tasks fails after others have written their rows.
    failing = spark.range(0, 1000, 1, 4).selectExpr("IF(id = 999, raise_error('power cut'), id) AS id")
    with pytest.raises(Exception, match="power cut"):
        layers.replace(ANALYTICS, "broken", failing)
    assert spark.table("analytics.broken").count() == layers.table(ANALYTICS, "broken").count() == 5
    assert layers.metrics(ANALYTICS, "broken")["row_count"] == 5
    assert len(spark.sql("SHOW TABLES IN analytics_versions").collect()) == before
    # A job that is killed leaves its version; the next one removes it.
    spark.range(3).write.saveAsTable("analytics_versions.broken__0_dead")
    assert layers.replace(ANALYTICS, "broken", spark.range(6)).count() == 6
    names = {r.tableName for r in spark.sql("SHOW TABLES IN analytics_versions LIKE 'broken__*'").collect()}
    assert len(names) == 2 and "broken__0_dead" not in names


def test_a_table_may_be_replaced_by_a_plan_on_itself(spark, stored, layers):
    layers.replace(ANALYTICS, "grown", spark.range(5))
    grown = layers.table(ANALYTICS, "grown")
    assert layers.replace(ANALYTICS, "grown", grown.union(grown)).count() == 10


def test_a_second_rebuild_gives_the_new_rows(spark, tmp_path):
    layers = Layers(spark, str(tmp_path), prefix="twice_")
    try:
        first = rebuild(layers, fixtures(spark))
        customers = first.customer_risk_scores.count()
        second = rebuild(layers, lambda table: fixtures(spark)(table).where("SK_ID_CURR % 2 = 0 OR SK_ID_CURR IS NULL"))
        assert 0 < second.customer_risk_scores.count() < customers
        assert second.customer_risk_scores.where("CUSTOMER_ID % 2 = 1").count() == 0
        assert spark.table("twice_analytics.dim_loan").count() == second.customer_risk_scores.count()
    finally:
        drop(spark, layers)


def test_rebuild_reports_counts_without_a_scan(spark, stored, layers):
    seen = stored_metrics(layers)
    for table in RAW_TABLES:
        assert seen[RAW, table]["row_count"] == stored.raw(table).count()
        assert seen[CLEANED, table]["row_count"] == stored.cleaned(table).count()
    assert seen[ANALYTICS, "customer_risk_scores"]["row_count"] == 150
    assert seen[ANALYTICS, "customer_risk_scores"]["repeated_keys"] == 0
    minima = REPORTS["bureau_minima"](stored).first().asDict()
    assert {name: seen[CLEANED, "bureau"][name] for name in minima} == minima
    rates = REPORTS["late_payment_rate"](stored).first()
    assert round(seen[CLEANED, INSTALLMENTS]["late_payment_pct"], 2) == rates.late_payment_pct
    assert seen[CLEANED, "credit_card_balance"]["avg_utilization_pct"] == REPORTS["card_metrics"](stored).first().avg_utilization_pct


def test_metrics_are_taken_in_the_plan_that_writes(spark, stored, layers, monkeypatch):
    """The metrics are one node above the rows that are written; each table is one scan of its inputs."""
    from pyspark.sql import DataFrameWriter
    plans, write = [], DataFrameWriter.saveAsTable

    def spy(self, name, *args, **kwargs):
        plans.append(plan_of(self._df))
        return write(self, name, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", spy)
    build(layers)
    assert len(plans) == 13
    for plan in plans:
        assert plan.count("CollectMetrics") == 1
    assert [plan.count("FileScan") for plan in plans[:6]] == [1] * 6


def test_a_violated_expectation_keeps_the_old_rows(spark, stored, layers):
    before = spark.table("cleaned_data.bureau").count()
    wanted = Range((CLEANED, "bureau"), "min_credit_sum", least=10 ** 9)
    with pytest.raises(ExpectationError, match=r"cleaned_data.bureau: min_credit_sum is [\d.]+, expected 1000000000 to None"):
        build(layers, (*GENERAL, wanted))
    assert spark.table("cleaned_data.bureau").count() == before
    with pytest.raises(ExpectationError, match="raw_data.application_train: row_count is 155, expected 307511"):
        load_raw(layers, fixtures(spark), PUBLISHED)
    with pytest.raises(ExpectationError, match="repeated_keys is 2, expected 0"):
        layers.replace(ANALYTICS, "doubled", spark.createDataFrame([(1,), (1,), (1,), (2,)], "k long"), unique_key="k",
                       check=lambda metrics: Range((ANALYTICS, "doubled"), "repeated_keys", 0, 0).check(metrics, layers))
    assert layers.metrics(ANALYTICS, "doubled") == {}


def test_buckets_follow_the_rows_not_the_session(spark, tmp_path):
    assert [bucket_count(n) for n in (0, 1, ROWS_PER_BUCKET, ROWS_PER_BUCKET + 1, 5 * ROWS_PER_BUCKET, 10 ** 12)] == [
        1, 1, 1, 2, 8, MOST_BUCKETS]
    threshold, shuffle = (spark.conf.get(f"spark.sql.{key}") for key in ("autoBroadcastJoinThreshold", "shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    layers, counts = Layers(spark, str(tmp_path), prefix="sized_"), []
    try:
        for setting in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", setting)
            keys = spark.range(1000).select((F.col("id") * 7).alias("CUSTOMER_ID"), F.lit(setting).alias("v"))
            tables = [layers.replace(ANALYTICS, f"t{i}", keys.withColumnRenamed("v", f"v{i}"), CUSTOMER, buckets=4)
                      for i in range(3) if setting == "3" or i]
            joined = layers.table(ANALYTICS, "t0").join(layers.table(ANALYTICS, "t1"), CUSTOMER).join(
                layers.table(ANALYTICS, "t2"), CUSTOMER)
            assert "Exchange" not in plan_of(joined) and joined.count() == 1000
            counts.append([len(t.inputFiles()) for t in tables][-2:])
        assert counts[0] == counts[1] == [4, 4]
        # The stored layers ask for their number of buckets themselves.
        rebuild(layers, fixtures(spark))
        assert {m["buckets"] for (layer, _), m in stored_metrics(layers).items() if "buckets" in m} == {1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        drop(spark, layers)


def test_layers_that_lie_elsewhere_are_an_error(spark, tmp_path):
    one = Layers(spark, f"{tmp_path}/one", prefix="p1_")
    two = Layers(spark, f"file://{tmp_path}/two", prefix="p2_")
    try:
        for n, layers in ((3, one), (4, two)):
            layers.replace(RAW, "bureau", spark.range(n))
        assert spark.table("p1_raw_data.bureau").count() == 3 and spark.table("p2_raw_data.bureau").count() == 4
        assert Layers(spark, f"{tmp_path}/one/", prefix="p1_").table(RAW, "bureau").count() == 3
        assert Layers(spark, prefix="p1_").table(RAW, "bureau").count() == 3
        with pytest.raises(ValueError, match="p1_raw_data lies in .*one/p1_raw_data already, not in .*two"):
            Layers(spark, f"{tmp_path}/two", prefix="p1_")
    finally:
        drop(spark, one), drop(spark, two)


def test_command_line(spark, stored, tmp_path, capsys):
    assert csv_paths("/data/", {"bureau": ".gz"})["bureau"] == "/data/bureau.csv.gz"
    main(["report", "top_high_risk"])
    assert "RISK_SCORE" in capsys.readouterr().out


def test_command_line_rebuild_from_csv(spark, portfolio, stored, tmp_path, capsys):
    for table in RAW_TABLES:
        rows = portfolio.raw(table).toPandas()
        # Nullable integers come back as floats from pandas, like 3.0 in the file.
        rows.to_csv(tmp_path / f"{table}.csv{'.gz' if table == INSTALLMENTS else ''}", index=False)
    main(["rebuild", "--csv", str(tmp_path), "--gzip", INSTALLMENTS, "--rejects", "1"])
    printed = capsys.readouterr().out
    assert "Medium Risk" in printed and "analytics.dim_customer: row_count 150" in printed
    main(["counts"])
    assert "cleaned_data.bureau: row_count 1406, min_credit_sum" in capsys.readouterr().out
    same(spark.table("analytics.customer_risk_scores"), portfolio.customer_risk_scores)
