"""Documents to packed training sequences: each stage works on all that the one before has kept.

A stage takes the session, the rows so far and the directory of tables, and returns rows; they are written as Parquet and
read again as the next stage's input. All but the last return the columns of ``documents``.

Defined results, as the stages' modules state them: null and empty texts are scored like others, equal to each other, near
to nothing, without secrets, and have the end id alone when packed; rows without a ``doc_id`` go through every stage; of
repeated rows one stays; texts of any length are handled whole; an empty table gives an empty result; the first four stages
keep further columns, whatever their names.

Stages share executors, whose memory holds a batch of texts several times in the JVM and in each Python worker: batches are
small (see ``small_batches``), a setting that stays in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanloom.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from loanloom.llm.common import small_batches, stored, work_folder
from loanloom.llm.queries import BYTE_BPE, PACKING_END, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def differing_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    small_batches(spark)
    return secret_scan.redact(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, BYTE_BPE, PACKING_END)


STAGES = [("quality", good_documents), ("exact_dedup", distinct_documents), ("near_dedup", differing_documents),
          ("secrets", without_secrets), ("packing", packed_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = work_folder(spark, "pipeline")
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), f"{folder}/{name}")
    return rows


# Trained scores and column generation cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
