"""Stored tables in three layers: ``raw_data``, ``cleaned_data`` and ``analytics``.

A table's name is a view on one of its versions; a version is a Parquet table that is written once. Replacing a table
writes a new version and then points the view at it, one change of the catalog: readers see the old rows or the new ones,
and a job that dies while it writes leaves the old ones. What a version holds (row count and other metrics) is observed while
it is written, checked before the switch, and kept with the view.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

RAW, CLEANED, ANALYTICS = LAYERS = ("raw_data", "cleaned_data", "analytics")

# A bucket gets about so many rows of a table with one row per key, unless there would be more than MOST_BUCKETS.
ROWS_PER_BUCKET = 250_000
MOST_BUCKETS = 1 << 14

# Of stored tables: they are written once and read several times, and take a third less than with Spark's default.
COMPRESSION = "zstd"

_METRICS, _VERSION = "loanloom.metrics", "loanloom.version"

Metrics = dict[str, int | float | None]


def bucket_count(rows: int) -> int:
    """Buckets for tables of ``rows`` keys: a power of two, so that it stays the same while a table grows a little."""
    wanted = min(max(-(-rows // ROWS_PER_BUCKET), 1), MOST_BUCKETS)
    return 1 << (wanted - 1).bit_length()


def _same_place(one: str, other: str) -> bool:
    a, b = urlsplit(one), urlsplit(other)
    return a.path.rstrip("/") == b.path.rstrip("/") and (not a.scheme or not b.scheme or (a.scheme, a.netloc) == (b.scheme, b.netloc))


class Layers:
    """The three layers as databases of the session's catalog.

    ``root`` must be a folder every executor can reach. Without it the tables go to the shared folder the cluster names
    in ``spark.checkpoint.dir``, or if there is none to ``spark.sql.warehouse.dir``. A layer that lies elsewhere already is
    an error if ``root`` is given. ``prefix`` is put before the names of the databases, so that several portfolios
    can live in one catalog.
    Tables can be queried by name, e.g. ``spark.sql("SELECT ... FROM analytics.customer_risk_scores")``.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, prefix: str = ""):
        self.spark = spark
        self.prefix = prefix
        shared = root or spark.conf.get("spark.checkpoint.dir", None)
        for layer in LAYERS:
            for database in (self._views(layer), self._versions(layer)):
                location = f"{shared.rstrip('/')}/{database}" if shared else None
                spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
                described = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE DATABASE {database}").collect()}
                if root and not _same_place(described["Location"], location):
                    raise ValueError(f"{database} lies in {described['Location']} already, not in {location}")

    def _views(self, layer: str) -> str:
        return f"{self.prefix}{layer}"

    def _versions(self, layer: str) -> str:
        return f"{self.prefix}{layer}_versions"

    def name(self, layer: str, table: str) -> str:
        """The name that SQL knows a table by."""
        return f"{self._views(layer)}.{table}"

    def _properties(self, layer: str, table: str) -> dict[str, str]:
        try:
            return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name(layer, table)}").collect()}
        except AnalysisException:
            return {}

    def metrics(self, layer: str, table: str) -> Metrics:
        """What was observed while the table's current version was written; empty if there is none. Reads no rows."""
        return json.loads(self._properties(layer, table).get(_METRICS, "{}"))

    def replace(self, layer: str, table: str, rows: DataFrame, unique_key: str | None = None, buckets: int = 1,
                observed: dict[str, Column] | None = None, check: Callable[[Metrics], None] = lambda metrics: None,
                rejected: str | None = None) -> DataFrame:
        """Write ``rows`` as the new content of a table and return the stored table.

        A table with one row per ``unique_key`` is bucketed by it: tables of one key that have as many ``buckets`` join
        without a shuffle, whatever the session's number of shuffle partitions. The rows are dealt to their buckets by one
        shuffle, so that each bucket is one file. A unique key cannot make a bucket large; tables with repeated keys stay
        unbucketed because one busy customer would.

        ``rejected`` names a flag of rows that are counted (``rejected_rows``) but not stored.
        ``observed`` are aggregates to take while the rows are written, beside ``row_count`` and, for a unique key,
        ``repeated_keys`` and ``missing_keys``. ``check`` may raise on them: the old rows then stay. The version before
        stays as well, for readers that have planned on it, until the table is replaced again. Only one job may write a
        table at a time.
        """
        metrics = {"row_count": F.count(F.lit(1)), **(observed or {})}
        if unique_key:
            # The shuffle to the buckets brings equal keys together.
            rows = rows.repartition(buckets, unique_key).withColumn("_nth", F.row_number().over(
                Window.partitionBy(unique_key).orderBy(unique_key)))
            metrics |= {"repeated_keys": F.count_if(F.col("_nth") > 1), "missing_keys": F.count_if(F.col(unique_key).isNull())}
        seen = Observation()
        if rejected:
            metrics |= {"row_count": F.count_if(~F.col(rejected)), "rejected_rows": F.count_if(rejected)}
        rows = rows.observe(seen, *[column.alias(name) for name, column in metrics.items()]).drop("_nth")
        if rejected:
            rows = rows.where(~F.col(rejected)).drop(rejected)
        version = f"{table}__{time.time_ns():x}_{uuid.uuid4().hex[:8]}"
        stored = f"{self._versions(layer)}.{version}"
        writer = rows.write.format("parquet").option("compression", COMPRESSION)
        if unique_key:
            writer = writer.bucketBy(buckets, unique_key).sortBy(unique_key)
        try:
            writer.saveAsTable(stored)
            taken = {name: seen.get.get(name) for name in metrics}
            taken["row_count"] = taken["row_count"] or 0
            check(taken)
        except BaseException:
            self.spark.sql(f"DROP TABLE IF EXISTS {stored}")
            raise
        before = self._properties(layer, table).get(_VERSION)
        kept = json.dumps({**taken, **({"buckets": buckets} if unique_key else {})}).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(layer, table)} "
                       f"TBLPROPERTIES ('{_VERSION}' = '{version}', '{_METRICS}' = '{kept}') AS SELECT * FROM {stored}")
        self._drop_versions(layer, table, {version, before})
        return self.table(layer, table)

    def _drop_versions(self, layer: str, table: str, but: set[str | None]) -> None:
        """Remove versions nobody needs any more, also those that a job left half written."""
        for row in self.spark.sql(f"SHOW TABLES IN {self._versions(layer)} LIKE '{table}__*'").collect():
            if row.tableName.rpartition("__")[0] == table and row.tableName not in but:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._versions(layer)}.{row.tableName}")

    def table(self, layer: str, table: str) -> DataFrame:
        """The current version of a table. What is planned on it keeps reading this version when the table is replaced."""
        version = self._properties(layer, table).get(_VERSION)
        return self.spark.table(f"{self._versions(layer)}.{version}" if version else self.name(layer, table))
