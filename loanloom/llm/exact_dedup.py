"""Exact duplicates through keyed streaming state.

Fingerprints (SHA-256 of the text, document id, and where the text lies: file and row) run as a stream into keyed state
that never expires and is kept on disk (RocksDB, snapshots in the shared folder). Per digest the state holds the row
that stays, its locator and the number of rows. The stream's partial aggregation reaches a digest with one row per task,
so a text that makes up a third of all rows loads no single task. Digests met more than once are checked byte by byte:
their full texts are grouped by digest and text, again with partial aggregation. Texts that differ under one digest
become groups of their own.

The same ``state`` folder can be given to a later run with more fingerprints: the stream goes on where it stopped.

Defined results: null text counts as empty. Of equal texts the row with the largest ``doc_id`` stays; a null id is
smaller than any other; of equal ids the row that lies last (file, row) stays, so exactly one row of a group is kept,
also among repeated rows. An empty table gives an empty result. Columns beside ``doc_id`` and ``text`` are ignored. Texts of any
length are hashed and compared whole, by Spark's own functions.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_possible, own_columns, stored, work_folder

_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All stores of an executor share one bounded cache, which stays full after the last of them is closed. A store holds one
    # partition, so few of its blocks are read twice.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # No space is set aside for logs that stay small: there are as many stores as shuffle partitions.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
    # A store is closed when its task has committed; else all stores of an executor, with their threads, stay open for minutes.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
_CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def fingerprints(docs: DataFrame, digest=sha256_hex) -> DataFrame:
    """One slim row per document: digest, id and locator. ``docs`` must come straight from files."""
    return docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _state_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose settings are those of the state store; the caller's stay as they are."""
    session = spark.newSession()
    for key, value in {**_STATE_STORE, **{k: spark.conf.get(k) for k in _CARRIED}}.items():
        session.conf.set(key, value)
    return session


def _update_state(session: SparkSession, feed: str, state: str, files_per_batch: int | None) -> None:
    """Run all fingerprints that have not been seen yet through the keyed state."""
    reader = session.readStream.schema("digest string, doc_id long, file string, row long").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    groups = reader.parquet(feed).groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    query = (groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _state(session: SparkSession, state: str) -> DataFrame:
    """The keyed state as a table: digest, stays (doc_id, file, row), group_size."""
    rows = session.read.format("statestore").load(state)
    stays, count = rows.schema["value"].dataType.names
    return rows.select(F.col("key.digest").alias("digest"), F.col(f"value.`{stays}`").alias("stays"),
                       F.col(f"value.`{count}`").alias("group_size"))


def collisions(docs: DataFrame, hits: DataFrame, digest=sha256_hex) -> DataFrame:
    """Digests of ``hits`` (column digest) under which different texts lie, by their full texts."""
    texts = docs.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = keep_possible(texts, hits, "digest").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("rows"))
    return distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def located(docs: DataFrame, folder: str) -> DataFrame:
    """Rows that lie in Parquet files: ``docs`` itself if it is read straight from some, else a stored copy."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return stored(docs, folder)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = located(docs, f"{work_folder(docs.sparkSession, 'dedup')}/documents")
    here = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    dropped = deduplicate(docs).where("NOT kept").select("file", "row")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *here).join(
        dropped, ["file", "row"], "left_anti").select("document.*")


def deduplicate(docs: DataFrame, state: str | None = None, files_per_batch: int | None = None,
                digest=sha256_hex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, file, row of every row of ``docs`` (columns doc_id and text).

    ``docs`` is read straight from Parquet files; other rows are stored first. ``digest`` must give hex digits.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "dedup")
    docs = located(own_columns(docs, "doc_id", "text"), f"{folder}/documents")
    # All runs on a state add to the folder its stream reads.
    state = state or f"{folder}/state"
    feed = f"{state.rstrip('/')}-feed"
    prints = stored(fingerprints(docs, digest), f"{feed}/{uuid.uuid4().hex}")
    session = _state_session(spark)
    _update_state(session, feed, state, files_per_batch)
    stored(_state(session, state), f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")

    hits = groups.where("group_size > 1").select("digest")
    differing = stored(collisions(docs, hits, digest), f"{folder}/collisions")
    joined = prints.join(groups, "digest")
    if differing.isEmpty():
        return _result(joined)
    # Different texts under one digest: group these rows by their full texts instead.
    own = docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.row_index").alias("row")).join(differing, "digest", "left_semi")
    by_text = own.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("stays"),
                                                F.count(F.lit(1)).alias("group_size"))
    own = own.join(by_text, ["digest", "text"]).drop("text")
    return _result(joined.join(differing, "digest", "left_anti").unionByName(own))


def _result(rows: DataFrame) -> DataFrame:
    here = F.struct("doc_id", "file", "row")
    return rows.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size",
                       here.eqNullSafe(F.col("stays")).alias("kept"), "digest", "file", "row")
