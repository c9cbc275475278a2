"""Token ids as ORC files in ascending order of document ids.

Rows are range partitioned and sorted by document id, encoded in that order and written: one file per partition, with
ids as run-length encoded integers, a row index every ``INDEX_ROWS`` rows and a Bloom filter on the document id. A
reader splits files by stripe, and a lookup of a document skips the stripes and row groups whose statistics or Bloom
filter exclude it. Each row also holds its file's part number and how many ids lie before it in the file, so that
global positions need one sum per file.

Defined results: null text is empty (the end id alone is stored); a null ``doc_id`` comes first; repeated ids lie next to
each other, ordered by a hash of the text; further columns are ignored; an empty table gives an empty table. A
long text is encoded as a whole; its ids are one list of one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

INDEX_ROWS = 1000
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(INDEX_ROWS),
    "orc.stripe.size": str(64 << 20), "orc.compress": "ZSTD",
}
SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to each document."""
    count = len(offsets) - 1
    out = np.empty(len(ids) + count, np.int32)
    ends = offsets[1:] + np.arange(count)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = ids
    out[ends] = end
    return out, offsets + np.arange(count + 1)


def _encode(path: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        own = encoder(path)
        for batch in slices(batches):
            ids, offsets = with_end(*own.encode(batch.column("text")), end)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "part": pa.array(np.full(batch.num_rows, part, np.int32)),
                "before": pa.array(before + offsets[:-1]), "n_tokens": pa.array(np.diff(offsets)),
                "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))})
            before += len(ids)
    return rows


def write_ids(docs: DataFrame, path: str, folder: str, end: int) -> None:
    """Encode ``docs`` (doc_id, text) with the vocabulary at ``path``, append ``end``, write to ``folder``."""
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = ordered.select("doc_id", "text").mapInArrow(_encode(path, end), SCHEMA)
    writer = rows.write
    for key, value in OPTIONS.items():
        writer = writer.option(key, value)
    writer.orc(folder)


def read_ids(spark: SparkSession, folder: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The stored rows, or those of some documents; the filter reaches the files' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("ids")
        raw = memoryview(column.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(lengths * 4)).tolist()
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "part": batch.column("part"), "before": batch.column("before"),
            "n_tokens": pa.array(lengths),
            "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())})


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every stored document."""
    rows = read_ids(spark, folder)
    # One row per file: few enough to be broadcast and put in order at any scale.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    sums = rows.select("doc_id", "part", "before", "ids").mapInArrow(
        _checksums, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return sums.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
