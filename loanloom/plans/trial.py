"""Trial loads and rebuilds: raw rows go through CSV files, plain and compressed, into stored layers of their own, and what
was observed there comes back as rows. The layers are dropped at the end; nothing else in the catalog is touched."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.plans.rebuild import build, load_csv, stored_metrics
from loanloom.sources.layers import LAYERS, RAW, Layers
from loanloom.sources.schemas import BUREAU, CARD, INSTALLMENTS, POS, PREVIOUS, RAW_TABLES

# Tables whose files are compressed: in the published data set those above 250 MB. A rebuild of a larger portfolio has such files of
# every table but the applications.
COMPRESSED = (INSTALLMENTS, POS, CARD)
REBUILT_COMPRESSED = (BUREAU, PREVIOUS, *COMPRESSED)

# A compressed file is read by one task, so no file gets more rows.
ROWS_PER_FILE = 200_000

# Column that is damaged, in which rows, and the text that stands there then.
DAMAGE = {
    BUREAU: ("DAYS_CREDIT", "SK_ID_BUREAU % 97 = 5", "n/a"),
    INSTALLMENTS: ("AMT_PAYMENT", "SK_ID_PREV % 101 = 7", "12,5 EUR"),
    CARD: ("CNT_DRAWINGS_CURRENT", "SK_ID_PREV % 89 = 3", "99999999999"),
}

Read = Callable[[str], DataFrame]


@contextmanager
def _trial(spark: SparkSession) -> Iterator[tuple[Layers, str]]:
    """Layers of a new prefix, and the name of a database for CSV files beside them."""
    layers = Layers(spark, prefix=f"trial_{uuid.uuid4().hex[:12]}_")
    files = f"{layers.prefix}files"
    try:
        lies = spark.sql(f"DESCRIBE DATABASE {layers.prefix}{RAW}").where("info_name = 'Location'").first().info_value
        spark.sql(f"CREATE DATABASE {files} LOCATION '{lies.rpartition('/')[0]}/{files}'")
        yield layers, files
    finally:
        for database in (files, *[f"{layers.prefix}{layer}{part}" for layer in LAYERS for part in ("", "_versions")]):
            spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


def _written(rows: DataFrame, name: str, compressed: bool) -> str:
    """The folder of the CSV files that ``rows`` are written to."""
    (rows.write.format("csv").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("compression", "gzip" if compressed else "none")
     .option("maxRecordsPerFile", ROWS_PER_FILE).saveAsTable(name))
    return rows.sparkSession.table(name).inputFiles()[0].rpartition("/")[0]


def rebuild_metrics(spark: SparkSession, read: Read) -> DataFrame:
    """table_name, metric, value: everything that a rebuild from CSV files observes while it writes its 19 tables."""
    with _trial(spark) as (layers, files):
        load_csv(layers, {table: _written(read(table), f"{files}.{table}", table in REBUILT_COMPRESSED)
                          for table in RAW_TABLES})
        build(layers)
        rows = [(f"{layer}.{table}", name, None if value is None else float(value))
                for (layer, table), metrics in stored_metrics(layers).items()
                for name, value in metrics.items() if name != "buckets"]
    return spark.createDataFrame(rows, "table_name string, metric string, value double")


def csv_rejects(spark: SparkSession, read: Read) -> DataFrame:
    """table_name, column_name, text, rejected_values, rejected_rows, row_count of a load of damaged CSV files."""
    with _trial(spark) as (layers, files):
        paths = {}
        for table, (column, where, text) in DAMAGE.items():
            damaged = F.when(F.expr(where), F.lit(text)).otherwise(F.col(column).cast("string"))
            paths[table] = _written(read(table).withColumn(column, damaged), f"{files}.{table}", table in COMPRESSED)
        load_csv(layers, paths, reject_limit=1 << 62)
        rows = []
        for table in DAMAGE:
            metrics = layers.metrics(RAW, table)
            groups = layers.table(RAW, f"{table}_rejects").groupBy("column", "text").agg(F.count(F.lit(1)).alias("values"))
            rows += [(table, r.column, r.text, r["values"], metrics["rejected_rows"], metrics["row_count"])
                     for r in groups.collect()]
    return spark.createDataFrame(rows, "table_name string, column_name string, text string, rejected_values long, "
                                       "rejected_rows long, row_count long")
