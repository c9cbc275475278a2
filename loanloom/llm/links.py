"""Links between documents: the components they make, and the links within buckets too large for pairs.

Components are found in rounds over stored tables, and only edges that point from a larger to a smaller id are kept. In a
round every task first folds its own edges by union-find, in windows of bounded size, so that what leaves a window is one
edge per id at most; then each id passes its smallest end on to its other ends. Edges are keyed by their larger end, which
has one edge per window, so the centre of a star is never a hot key. When every id has one edge left, edges are followed to
their end by pointer jumping, whose joins Spark splits where many ids have the same end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored

# Edges that are folded at once: some tens of MB.
WINDOW = 1 << 20
# Members of a large bucket that are compared with as many others in one task.
CHUNK = 512


# --- components -------------------------------------------------------------------------------------------------------

def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of the edges (a, b), and the smallest id each is connected with."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    parent = np.arange(len(ids))
    while True:
        of_x, of_y = parent[x], parent[y]
        apart = of_x != of_y
        if not apart.any():
            return ids, ids[parent]
        x, y, of_x, of_y = x[apart], y[apart], of_x[apart], of_y[apart]
        np.minimum.at(parent, np.maximum(of_x, of_y), np.minimum(of_x, of_y))
        while not np.array_equal(higher := parent[parent], parent):
            parent = higher


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fold(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        ids, least = least_connected(u, v)
        moved = ids != least
        return pa.RecordBatch.from_pydict({"u": pa.array(ids[moved]), "v": pa.array(least[moved])})

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= WINDOW:
            yield fold(held)
            held, rows = [], 0
    if rows:
        yield fold(held)


def _round(edges: DataFrame, several: Observation | None = None) -> DataFrame:
    """Edges (u, v), u > v, that connect what ``edges`` connect; ``several`` counts ids that had more than one end."""
    ends = edges.mapInArrow(_folded, "u long, v long").groupBy("u").agg(F.collect_set("v").alias("ends"))
    ends = ends.withColumn("least", F.array_min("ends"))
    if several:
        ends = ends.observe(several, F.count_if(F.size("ends") > 1).alias("ids"))
    own = F.array(F.struct("u", F.col("least").alias("v")))
    others = F.transform(F.array_except("ends", F.array("least")), lambda end: F.struct(end.alias("u"), F.col("least").alias("v")))
    return ends.select(F.inline(F.concat(own, others)))


def components(links: DataFrame, folder: str) -> DataFrame:
    """doc_id, component_id of every document in ``links`` (a, b); component_id is the smallest one connected with it."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    step = 0
    while True:
        several = Observation()
        edges = stored(_round(_round(edges), several), f"{folder}/round{step}")
        if not several.get["ids"]:
            break
        step += 1
    step = 0
    while True:
        moved = Observation()
        onward = edges.select(F.col("u").alias("v"), F.col("v").alias("further"))
        joined = edges.join(onward, "v", "left").observe(moved, F.count("further").alias("ids"))
        edges = stored(joined.select("u", F.coalesce("further", "v").alias("v")), f"{folder}/jump{step}")
        if not moved.get["ids"]:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
        step += 1


# --- classes of equal documents ---------------------------------------------------------------------------------------

def shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between a doc_id that occurs with different sets and the heads of the classes of all of them.

    ``rows`` has doc_id and digest (null for an empty set), ``classes`` digest and head.
    """
    known = rows.where("doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last"),
                                          F.count("digest").alias("full"), F.count(F.lit(1)).alias("all"))
    several = several.where("first <> last OR (full > 0 AND full < all)").select("doc_id")
    meet = known.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(
        classes.select("digest", "head"), "digest")
    return meet.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))


def with_components(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with component_id: of the class's head, or without a set of the doc_id itself."""
    known = found.withColumnRenamed("doc_id", "node")
    headed = rows.join(classes.select("digest", "head"), "digest", "left").withColumn("node", F.coalesce("head", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "node"))
    return headed.join(known, "node", "left").select(*rows.columns, component.alias("component_id"))


# --- large buckets ----------------------------------------------------------------------------------------------------

def unsettled(members: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """Buckets whose members (bucket, doc_id) lie in several components of ``found``, merged by the largest component.

    Rows of bucket, doc_id, label, main, in_main, others: the members of all buckets with one main component, each once,
    with their own component, and how many of them lie in the main one and outside.
    """
    labelled = members.join(found, "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component_id", "doc_id").alias("label"))
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    mains = mains.where("labels > 1").select("bucket", F.col("main.label").alias("main"))
    merged = stored(labelled.join(mains, "bucket").select("main", "doc_id", "label").distinct(), f"{folder}/merged")
    counts = merged.groupBy("main").agg(F.count_if(F.col("label") == F.col("main")).alias("in_main"),
                                        F.count_if(F.col("label") != F.col("main")).alias("others"))
    return merged.join(counts, "main").select(F.col("main").alias("bucket"), "doc_id", "label", "main", "in_main", "others")


def chunk_links(rows: DataFrame, sets: DataFrame, threshold: int, sketch: Sequence[str] = (),
                unlike: Callable[[np.ndarray, int], np.ndarray] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between components within buckets, from rows of bucket, doc_id, label, main, in_main, others.

    ``unlike`` may tell from the columns ``sketch`` which pairs cannot reach the threshold.

    Chunks number the members by a hash: those of the main component from 0 up, others from -1 down. Every chunk of others
    meets every chunk of the bucket; chunks of the main component do not meet each other.
    """
    spread = F.xxhash64("doc_id", "bucket")
    is_main = F.col("label") == F.col("main")
    mains, others = (F.ceil(F.col(c) / chunk).cast("int") for c in ("in_main", "others"))
    rows = rows.withColumn("chunk", F.when(is_main, F.pmod(spread, mains)).otherwise(-1 - F.pmod(spread, others)).cast("int"))
    # The pairs (low, high) of chunks a member takes part in; low is always a chunk of others.
    lows = F.transform(F.sequence(F.lit(1), others), lambda i: F.struct((-i).alias("low"), F.col("chunk").alias("high")))
    own = F.filter(lows, lambda p: p["low"] <= p["high"])
    highs = F.transform(F.sequence(-others, mains - 1), lambda i: F.struct(F.col("chunk").alias("low"), i.cast("int").alias("high")))
    both = F.when(is_main, lows).otherwise(F.array_distinct(F.concat(own, F.filter(
        highs, lambda p: p["low"] <= p["high"]))))
    tasks = rows.select("bucket", F.explode(both).alias("p"), "doc_id", "label", *sketch)
    tasks = tasks.join(sets, "doc_id").select("bucket", "p.low", "p.high", "doc_id", "label", *sketch, "shingles")

    def links(table: pa.Table) -> pa.Table:
        if unlike:
            columns = np.stack([table.column(name).to_numpy() for name in sketch], axis=1)
            labels = table.column("label").to_numpy()
            possible = ~unlike(columns, threshold) & (labels[:, None] != labels[None, :])
            table = table.filter(pa.array(possible.any(axis=1)))
        return compare_chunks(table, threshold)

    return tasks.groupBy("bucket", "low", "high").applyInArrow(links, "a long, b long").distinct()


def compare_chunks(table: pa.Table, threshold: int) -> pa.Table:
    """Links that connect labels, between the two chunks in ``table`` (or within the one there is), fewer than labels."""
    ids, labels = table.column("doc_id").to_numpy(), table.column("label").to_numpy()
    column = table.column("shingles").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, words = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    shared = np.zeros((len(ids), len(ids)), np.float32)
    width = 4096
    for begin in range(0, int(words[-1]) + 1 if len(words) else 0, width):
        a, b = np.searchsorted(words, [begin, begin + width])
        held = np.zeros((len(ids), width), np.float32)
        held[owner[a:b], words[a:b] - begin] = 1
        shared += held @ held.T
    linked = 100 * shared >= threshold * (sizes[:, None] + sizes[None, :] - shared)
    linked &= labels[:, None] != labels[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    # Labels are ids of members of their components, so links between labels connect the same documents.
    ends, least = least_connected(labels[i], labels[j])
    moved = ends != least
    return pa.table({"a": pa.array(least[moved]), "b": pa.array(ends[moved])})
