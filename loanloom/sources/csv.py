"""Typed reader for the raw CSV files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanloom.sources.schemas import raw_types

# Marks rows that ``checked_csv`` rejects.
REJECTED = "_rejected"


def _typed(text: Column, type_name: str, cast: Callable[[Column, str], Column] = Column.cast) -> Column:
    # Whole numbers may be written as 3.0; going through a decimal accepts that and still rejects text. Most are not and
    # need no decimal.
    if type_name in ("INT", "BIGINT"):
        return F.coalesce(text.try_cast(type_name), cast(cast(text, "decimal(38,0)"), type_name))
    return cast(text, type_name)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)


def _spread(rows: DataFrame, path: str) -> DataFrame:
    """A gzip file is read by one task: if one of the files is such and has more than twice a core's share of all bytes, deal
    the rows out over the cluster. Many files of like size are read in parallel anyway, and their rows stay where they are."""
    spark = rows.sparkSession
    # The folder's listing: no file is opened for it.
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    largest = max((f.length for f in files if f.path.lower().endswith(".gz")), default=0)
    if largest * spark.sparkContext.defaultParallelism > 2 * sum(f.length for f in files):
        return rows.hint("rebalance")
    return rows


def read_raw_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read a raw table from CSV with a header line: a file, a folder or a glob, plain or ``.gz`` or both.

    Columns are taken by name, so files may hold more columns or another order; a missing column or a value that does
    not fit its type is an error. Empty fields are NULL.

    Rows of few or unlike gzip files are spread over the cluster before the casts, so that everything after the decompression
    runs in parallel; load once and keep the result as Parquet.
    """
    types = raw_types(table)
    read = _texts(spark, path)
    text = _spread(read.select(*types), path)
    return text.select(*[_typed(text[column], type_name).alias(column) for column, type_name in types.items()])


@dataclass(frozen=True)
class CheckedCsv:
    """``rows``: every row, typed, with ``REJECTED`` set where a value does not fit its type (it is NULL there). ``rejects``:
    file, row, column and text of each such value; row is the record's number in its file, from 1 on, header not counted."""

    rows: DataFrame
    rejects: DataFrame


def checked_csv(spark: SparkSession, path: str, table: str) -> CheckedCsv:
    """Read a raw table like ``read_raw_csv``, but collect values that do not fit instead of ending at the first one.

    Records are numbered without a sort: within a split of a file they are numbered as they are read, and the splits'
    record counts, one row per split, tell where each one begins.
    """
    types = raw_types(table)
    read = _texts(spark, path)
    typed = {column: _typed(F.col(column), type_name, Column.try_cast) for column, type_name in types.items()}
    unfit = {column: F.col(column).isNotNull() & value.isNull() for column, value in typed.items()}
    any_unfit = F.greatest(*[F.coalesce(bad, F.lit(False)) for bad in unfit.values()])
    rows = _spread(read.select(*types), path).select(*[value.alias(column) for column, value in typed.items()],
                                                     any_unfit.alias(REJECTED))

    numbered = read.select(*types, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                           F.monotonically_increasing_id().alias("_at"))
    splits = numbered.groupBy("_file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_records"))
    before = F.sum("_records").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_file", "_split", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    values = F.array(*[F.when(bad, F.struct(F.lit(column).alias("column"), F.col(column).alias("text")))
                       for column, bad in unfit.items()])
    rejects = numbered.where(any_unfit).select("_file", "_split", "_at", F.explode(values).alias("value")).where("value IS NOT NULL")
    rejects = rejects.join(splits, ["_file", "_split"]).select(
        F.col("_file").alias("file"), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("row"), "value.column",
        "value.text")
    return CheckedCsv(rows, rejects)
