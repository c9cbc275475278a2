"""Files of trial loads, and what reading many of them moves."""

import gzip
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from loanloom.plans import trial
from loanloom.sources.csv import checked_csv, read_raw_csv
from loanloom.sources.layers import RAW, Layers
from loanloom.sources.schemas import INSTALLMENTS, raw_types

NAMES = list(raw_types(INSTALLMENTS))


def parts(folder, *sizes):
    folder.mkdir()
    for i, size in enumerate(sizes):
        with gzip.open(folder / f"p{i:02d}.csv.gz", "wt") as file:
            file.write("\n".join([",".join(NAMES), *(f"{n},{i},1.0,{n % 9},-10,-12.0,{n}.25,5.5" for n in range(size))]))
    return str(folder)


def test_rows_of_many_like_files_stay_where_they_are(spark, tmp_path):
    """One file beside small ones is dealt out, and so are too few; many of like size are not moved."""
    cores = spark.sparkContext.defaultParallelism
    for name, sizes, moved in (("like", [300] * 2 * cores, False), ("one", [9000, *[10] * 2 * cores], True), ("few", [300], True)):
        path = parts(tmp_path / name, *sizes)
        for rows in (read_raw_csv(spark, path, INSTALLMENTS), checked_csv(spark, path, INSTALLMENTS).rows):
            assert ("REBALANCE" in plan_of(rows).upper()) == moved, name
            assert rows.count() == sum(sizes) and rows.agg(F.sum("AMT_INSTALMENT")).first()[0] is not None


@pytest.mark.parametrize("text", ["7", " 7 ", "+7", "7.0", "7.4", "6.5", "7e0", "-3", "2147483647", "2147483648", "99999999999",
                                  "x", "1,5", "1e3", "0x1", "7.", ".5", "", "NaN"])
def test_whole_numbers_are_those_of_a_decimal(spark, tmp_path, text):
    (tmp_path / "rows.csv").write_text("\n".join([",".join(NAMES), f'1,1,1.0,"{text}",1,1,1,1']))
    got = checked_csv(spark, str(tmp_path / "rows.csv"), INSTALLMENTS).rows.select("NUM_INSTALMENT_NUMBER").first()[0]
    decimal = F.lit(text or None).cast("string").try_cast("decimal(38,0)").try_cast("int")
    assert got == spark.range(1).select(decimal).first()[0]


def test_whole_numbers_need_no_decimal(spark, tmp_path):
    rows = read_raw_csv(spark, parts(tmp_path / "parts", 5), INSTALLMENTS)
    assert re.search(r"coalesce\((try_)?cast\(NUM_INSTALMENT_NUMBER#\d+ as int\)", plan_of(rows))


def test_files_and_stored_tables_are_compact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trial, "ROWS_PER_FILE", 100)
    rows = spark.range(950).coalesce(1)
    spark.sql(f"CREATE DATABASE trial_files LOCATION '{tmp_path}/files'")
    try:
        trial._written(rows, "trial_files.rows", True)
        files = spark.table("trial_files.rows").inputFiles()
        assert len(files) == 10 and all(file.endswith(".csv.gz") for file in files)
    finally:
        spark.sql("DROP DATABASE trial_files CASCADE")
    stored = Layers(spark, f"{tmp_path}/layers", prefix="compact_").replace(RAW, "bureau", rows)
    assert all(file.endswith(".zstd.parquet") for file in stored.inputFiles()) and stored.count() == 950
