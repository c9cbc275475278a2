"""One row per key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a plan may do to the rows of a file for each of them still to be a row of that file.
_ROW_BY_ROW = ("Project", "Filter")


def row_locator(rows: DataFrame) -> Column | None:
    """Where each row lies (file, number of the row in it), or None where rows do not come straight from Parquet files.

    Spark fills in both without reading a column. Operators that copy or merge rows (explode, distinct, union, join) have
    no locator, nor have renamed plans (``alias``) and formats without row numbers, such as CSV.
    """
    plan = rows._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROW_BY_ROW:
        plan = plan.children().head()
    while plan.nodeName() == "SubqueryAlias":  # a table's name
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or not plan.toString().rstrip().endswith(" parquet"):
        return None
    try:
        rows.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def first_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Keep the first row of each key by ``order``; rows with a NULL key must be gone already.

    Rows still tied are ordered by where they lie in their files, so a task that runs again picks the same survivor, and
    no column is read that nobody asks for. Rows without a locator are ordered by a hash of all their columns; it is
    computed before the shuffle, so that unused columns end at the scan.

    Spark turns the rank filter into a group limit on both sides of the shuffle. Each map task sends at most one row
    per key, so a key that holds a third of the table does not meet in one reduce task.
    """
    tie = row_locator(rows)
    by_key = Window.partitionBy(key).orderBy(*order, "_tie")
    return (rows.withColumn("_tie", F.xxhash64(*rows.columns) if tie is None else tie)
            .withColumn("_rank", F.row_number().over(by_key))
            .filter(F.col("_rank") == 1)
            .drop("_rank", "_tie"))


def latest_per_key(rows: DataFrame, key: str, recency: str) -> DataFrame:
    """Keep the row with the largest ``recency``; a NULL there sorts first and wins."""
    return first_per_key(rows, key, F.col(recency).desc_nulls_first())
