"""Join of documents whose sets of five-word shingles have a high Jaccard similarity, by prefixes under several global orders.

Two sets whose similarity reaches the threshold share a shingle among the first ``n - ceil(threshold * n) + 1`` of either
in any order of all shingles. That holds for several orders at once, and a pair goes on only if it shares prefix shingles
under each. All orders put rare shingles first: shingles are ranked in classes of how often they occur, and within a class
every order has its own hash. The classes come from a table of fixed size over all documents: each task counts the shingles
of a window of its documents, what occurs more than once in a window is added up, and the table's cell of a shingle
holds the largest class that fell there. So an order is the same function in every task and never wrong; collisions and
shingles missed in the windows only make prefixes a little less rare.

The first order makes buckets: prefix shingles shared by different sets. A bucket of up to ``SMALL`` members gives all its
pairs. A larger one gives the pairs of one member with all others, and once components are known, those of its members that
are not in its main component are compared with all others in chunks (see ``links``). Nothing is left out, and a bucket of
connected copies costs one pair per member. Equal sets form a class, for which its smallest document stands.

Defined results: null text is empty; an empty set is linked with nothing; a text of fewer than five words is one shingle;
a row without ``doc_id`` is linked with nothing and has no component; rows that share a ``doc_id`` count as one document,
linked through any of its texts; an empty table gives an empty result; further columns are ignored. A text is hashed
as a whole, which takes some tens of bytes per byte of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, keep_possible, mix, slices, stored, work_folder
from .links import chunk_links, components, shared_ids, unsettled, with_components
from .near_dedup import confirmed, full_sets, shingle_sets

# Similarity in percent.
THRESHOLD = 80
ORDERS = 3
SMALL = 32
# The table of classes has 2 ** TABLE_BITS cells, 8 MB; a class begins at each of these counts.
TABLE_BITS = 23
COMMON_FROM = (2, 8, 32, 128, 512, 2048, 8192)
# Shingles counted at once in a task, 8 bytes each.
WINDOW = 1 << 22

_SEEDS = np.random.default_rng(20250412).integers(1 << 63, size=ORDERS, dtype=np.uint64)


# --- how common shingles are ------------------------------------------------------------------------------------------

def _repeated(held: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    often = counts > 1
    return _rows(token=values[often].view(np.int64), times=counts[often])


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()), ("token", pa.int64()),
                     ("times", pa.int64())])


def _rows(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
                                       for f in _SKETCH], schema=_SKETCH)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows of the shingles that occur more than once in a window."""
    held, count = [], 0
    for batch in slices(batches):
        sizes, digests = [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None)
            held.append(shingles)
            count += len(shingles)
        yield _rows(doc_id=batch.column("doc_id").to_pylist(), n_shingles=sizes, digest=digests)
        if count >= WINDOW:
            yield _repeated(held)
            held, count = [], 0
    if count:
        yield _repeated(held)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def class_table(repeated: DataFrame) -> np.ndarray:
    """The class of each cell, from rows of token and times: at most 2 ** TABLE_BITS bits per class come to the driver."""
    cell = F.shiftrightunsigned("token", 64 - TABLE_BITS)
    counted = repeated.groupBy("token").agg(F.sum("times").alias("times"))
    rank = sum((F.when(F.col("times") >= least, 1).otherwise(0) for least in COMMON_FROM), F.lit(0))
    # Positions count from 1 on: bucket 1 holds the bits 0 to 32767.
    cells = counted.select((cell + 1).alias("at"), F.explode(F.sequence(F.lit(1), rank)).alias("rank")).where("rank > 0")
    bits = cells.groupBy("rank", F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    for rank, part, packed in zip(*(column.to_pylist() for column in bits.toArrow().columns)):
        own = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
        span = table[(part - 1) * len(own):part * len(own)]
        np.maximum(span, own[:len(span)] * np.uint8(rank), out=span)
    return table


# --- prefixes ---------------------------------------------------------------------------------------------------------

def prefix_length(size: int, threshold: int) -> int:
    return size - -(-threshold * size // 100) + 1


def prefixes(shingles: np.ndarray, table: np.ndarray, threshold: int) -> list[np.ndarray]:
    """The first shingles under each order."""
    length = prefix_length(len(shingles), threshold)
    ranks = table[_cells(shingles)].astype(np.uint64) << np.uint64(60)
    firsts = []
    for seed in _SEEDS:
        order = ranks | (mix(shingles ^ seed) >> np.uint64(4))
        firsts.append(shingles[np.argpartition(order, length - 1)[:length]] if length < len(shingles) else shingles)
    return firsts


def _prefix_rows(docs: DataFrame, table: np.ndarray, threshold: int) -> DataFrame:
    """doc_id, key (a hash of its set), p0 and, as halves of hashes, p1, p2, ... of the documents that have a set."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys, firsts = [], [], [[] for _ in range(ORDERS)]
            for doc_id, shingles in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"))):
                if len(shingles):
                    ids.append(doc_id)
                    keys.append(int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True))
                    for held, first in zip(firsts, prefixes(shingles, shared.value, threshold)):
                        held.append(first)
            if not ids:
                continue
            ends = pa.array(np.append(0, np.cumsum([len(f) for f in firsts[0]])).astype(np.int32))
            first, *others = (np.concatenate(f) for f in firsts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()),
                "p0": pa.ListArray.from_arrays(ends, pa.array(first.view(np.int64))),
                **{f"p{i}": pa.ListArray.from_arrays(ends, pa.array(o.astype(np.uint32).view(np.int32)))
                   for i, o in enumerate(others, 1)}})

    slim = ", ".join(f"p{i} array<int>" for i in range(1, ORDERS))
    return docs.where("doc_id IS NOT NULL").mapInArrow(run, f"doc_id long, key long, p0 array<long>, {slim}")


def _buckets(firsts: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """bucket, doc_id, n_shingles, members, leader: prefix shingles that different sets share, by the heads of classes."""
    entries = firsts.select("doc_id", "key", F.explode("p0").alias("token"))
    shared = entries.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    shared = stored(shared.select("token", F.hex("token").alias("digits")), f"{folder}/shared")
    entries = keep_possible(entries.select("doc_id", "token", F.hex("token").alias("digits")), shared, "digits")
    entries = entries.join(shared.select("token"), "token", "left_semi").select(F.col("token").alias("bucket"), "doc_id")
    heads = classes.select(F.col("head").alias("doc_id"), "n_shingles")
    members = stored(entries.join(heads, "doc_id").distinct(), f"{folder}/entries")
    # Any member can lead; it differs between buckets, so that a document has many leaders over all its buckets.
    by_hash = F.min(F.struct(F.xxhash64("doc_id", "bucket"), F.col("doc_id"), F.col("n_shingles")))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), by_hash.alias("leader")).where("members > 1")
    return stored(members.join(sizes, "bucket").select(
        "bucket", "doc_id", "n_shingles", "members", F.col("leader.doc_id").alias("leader"),
        F.col("leader.n_shingles").alias("leader_size")), f"{folder}/buckets")


def candidates(buckets: DataFrame, threshold: int, small: int) -> DataFrame:
    """Pairs (a, b) of small buckets, and of the leaders of large ones, whose sizes allow the threshold."""
    few = buckets.where(F.col("members") <= small).groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "n_shingles"))).alias("docs"))
    few = few.select(F.posexplode("docs").alias("at", "x"), "docs").select("x", F.explode(
        F.slice("docs", F.col("at") + 2, F.size("docs"))).alias("y"))
    few = few.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n_shingles").alias("a_size"),
                     F.col("y.n_shingles").alias("b_size"))
    led = buckets.where((F.col("members") > small) & (F.col("doc_id") != F.col("leader"))).select(
        F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"),
        F.col("n_shingles").alias("a_size"), F.col("leader_size").alias("b_size"))
    alike = 100 * F.least("a_size", "b_size") >= threshold * F.greatest("a_size", "b_size")
    return few.unionByName(led).where(alike).select("a", "b").distinct()


def sharing(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs that share prefix shingles under the further orders as well."""
    names = [f"p{i}" for i in range(1, ORDERS)]
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().select(
        "doc_id", F.md5(F.col("doc_id").cast("string")).alias("digits"))
    slim = firsts.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("digits"), *names)
    slim = keep_possible(slim, wanted, "digits").drop("digits").distinct()
    side = {x: slim.select(F.col("doc_id").alias(x), *[F.col(p).alias(f"{x}_{p}") for p in names]) for x in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    for p in names:
        both = both.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
    return both.select("a", "b").distinct()


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))


def similar_documents(docs: DataFrame, threshold: int = THRESHOLD, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (columns doc_id and text)."""
    folder = work_folder(docs.sparkSession, "join")
    docs = _documents(docs)
    sketches = stored(docs.mapInArrow(_sketches, _SKETCH_ROWS), f"{folder}/sketches")
    rows = sketches.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "digest")
    table = class_table(sketches.where("token IS NOT NULL").select("token", "times"))
    firsts = stored(_prefix_rows(docs, table, threshold), f"{folder}/prefixes")
    classes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest", "n_shingles").agg(
        F.min("doc_id").alias("head"))
    classes = stored(classes, f"{folder}/classes")
    buckets = _buckets(firsts, classes, folder)
    pairs = stored(sharing(candidates(buckets, threshold, small), firsts), f"{folder}/pairs")
    large = buckets.where(F.col("members") > small).select("bucket", "doc_id")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(large.select("doc_id")).distinct()
    sets = stored(full_sets(docs, wanted).distinct(), f"{folder}/sets")
    links = stored(confirmed(sets, pairs, threshold).unionByName(shared_ids(rows, classes)), f"{folder}/links")
    found = components(links, f"{folder}/first")
    rest = unsettled(large, found, folder)
    more = stored(chunk_links(rest, sets, threshold), f"{folder}/chunks")
    if not more.isEmpty():
        known = found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        found = components(known.unionByName(more), f"{folder}/last")
    return finished(with_components(rows, classes, found).drop("digest"), folder)


_SKETCH_ROWS = "doc_id long, n_shingles long, digest string, token long, times long"
