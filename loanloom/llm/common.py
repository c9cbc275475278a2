"""Helpers the operators share: work folders, texts as numpy arrays, hashes of byte ranges."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are handled in slices of about so many bytes; the arrays beside a slice take a few tens of times that.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


# --- work folders -----------------------------------------------------------------------------------------------------

SHARED = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="loanloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share, below the one that ``spark.checkpoint.dir`` names. Where that is unset
    and all tasks run in the driver's process, as in tests, it lies below a temporary folder that goes with the process; on a
    cluster each executor would write to its own disk there, so that is an error."""
    shared = spark.conf.get(SHARED, None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SHARED} is not set: it must name a folder that driver and executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/loanloom-{purpose}-{uuid.uuid4().hex}"


def finished(rows: DataFrame, folder: str) -> DataFrame:
    """Store ``rows`` in a work folder and remove everything else there: the tables that lead to them are read no more."""
    result = stored(rows, f"{folder}/result")
    context = rows.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    for status in files.listStatus(path):
        if status.getPath().getName() != "result":
            files.delete(status.getPath(), True)
    return result


# Spark removes what a query shuffled when it ends, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` as Parquet and return the written table: lineage ends here, lost executors cost no recomputation, and
    what was shuffled on the way is removed at once."""
    with _tidy(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# Spark sends 10,000 rows a batch to Python unless told otherwise: some 20 MB of texts, several times in either process.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers ``BATCH_ROWS`` at a time, unless the session's owner has set a number."""
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


def own_columns(rows: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input cannot clash with those an operator adds."""
    return rows.select(*[F.col(f"`{name}`") for name in names])


# --- texts as arrays --------------------------------------------------------------------------------------------------

def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins (with the end of the last). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's ``malloc_trim``, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def release() -> None:
    """Give memory that is no longer used back to the system. A Python worker lives on after its task, and what the arrays
    beside its slices took would stay with it, beside whatever the executor does next."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice take about ``limit`` bytes (a longer text is a slice of its own). After the
    last one unused memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
    release()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


@lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    forward = np.full(count, _MULTIPLIER, np.uint64)
    backward = np.full(count, _INVERSE, np.uint64)
    forward[0] = backward[0] = 1
    return np.cumprod(forward), np.cumprod(backward)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)``; equal bytes have equal hashes wherever they lie.

    The ranges' polynomial hashes are differences of one running sum, so that no range is touched by itself.
    """
    size = 1 << max(20, int(len(data)).bit_length())
    forward, backward = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, forward[:len(data)], out=sums[1:], dtype=np.uint64, casting="unsafe")
    np.cumsum(sums, out=sums)
    hashes = (sums[ends] - sums[starts]) * backward[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_ranges(data: np.ndarray, offsets: np.ndarray,
                between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words begin and end, and the index of each text's first word. Words are runs without the bytes marked in
    ``between``, by default ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


# --- bounded filter before a join -------------------------------------------------------------------------------------

# One bit per value of the first 26 bits of a digest: at most 2,048 rows of 4 KB, 8 MB, whatever the input's size.
FILTER_BITS = 26


def _filter_position(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 7), 16, 10).cast("long").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def keep_possible(rows: DataFrame, keys: DataFrame, digest: str) -> DataFrame:
    """The rows whose hex digest may occur among ``keys``; a row is lost only if it surely does not.

    The keys are folded into a bitmap of fixed size, which is small enough to be broadcast at any scale. With very many
    keys it lets more rows pass, never fewer.
    """
    keys = keys.select(_filter_position(F.col(digest)).alias("position"))
    bitmap = keys.groupBy(F.bitmap_bucket_number("position").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits"))
    at = _filter_position(F.col(digest))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(F.bitmap_bit_position(at), 3).cast("int") + 1,
                                    F.lit(1))), 16, 10).cast("long")
    bit = F.expr("shiftright(filter_byte, cast(filter_bit as int)) & 1 = 1")
    joined = rows.withColumn("filter_bucket", F.bitmap_bucket_number(at)).join(
        F.broadcast(bitmap), F.col("filter_bucket") == F.col("bucket"))
    joined = joined.withColumn("filter_byte", byte).withColumn("filter_bit", F.bitmap_bit_position(at) % 8)
    return joined.where(bit).select(*rows.columns)
