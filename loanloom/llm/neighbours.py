"""Approximate nearest neighbours by collision counting over single projections.

Vectors are cut into blocks of bounded size. A block's index is one sorted array per random projection. A query places a
window around its own projection in every array; a vector collides once for each window that holds it. Windows take the first
of a row of widths (virtual rehashing: wider buckets without a new index) at which vectors of enough distinct ids other than
the query's own reach the collision threshold. All of those are verified: their cosines are computed in double precision on
the original vectors. A query's best of all blocks are its neighbours.

Equal rows (same ``vec_id``, same components) are merged before the blocks are cut, so copies take no room in them.

Queries are a stated set of rows; block by block they meet every vector. Work moves as whole blocks, never as pairs, and
each pair of blocks is a task's worth of bounded size.

Defined results: vectors that are null, empty, zero, of another length than most or hold null or non-finite components take
no part, neither do rows without a ``vec_id``; rows that share a ``vec_id`` are one item with the best of their scores; ties go
to the smaller ``vec_id``; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, work_folder

PROJECTIONS = 96
# Collisions from which a vector is verified, as a share of the projections.
COLLISIONS = 0.6
# A block's windows grow until this share of its ids, or at least so many, reach the threshold (or all are covered). Ids are
# counted once, whatever their number of vectors, and without the query's own.
ENOUGH_SHARE, ENOUGH = 0.12, 120
FIRST_WIDTH, GROWTH = 0.5, 1.1
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 2048

_VECTORS = "side int, vec_id long, embedding array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"),
                          F.col("`embedding`").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).where(some)


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores wherever they lie."""
    return (vectors * query).sum(axis=1) / (norms * norm)


class BlockIndex:
    """Sorted projections of a block's vectors, and each vector's rank in every one of them.

    A window is a range of ranks. All vectors' ranks are compared with it at once: among vectors without structure a window
    holds about half of its block, and fetching those one by one through the sorted order took several times as long."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        self.distinct = np.unique(ids)
        self.single = len(self.distinct) == len(ids)
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], projections))
        values = ((vectors / self.norms[:, None]) @ self.directions).T
        order = np.argsort(values, axis=1, kind="stable")
        # The arrays lie one after the other, each lifted above the one before, so that one search finds all windows.
        self.lift = np.arange(projections) * 1000.0
        self.sorted = (np.take_along_axis(values, order, axis=1) + self.lift[:, None]).ravel()
        self.begins = np.arange(projections) * len(ids)
        # The narrowest type that holds the block's size: ranks below a window wrap around to numbers above its length.
        self.ranks = np.empty(order.shape, np.min_scalar_type(len(ids)))
        np.put_along_axis(self.ranks, order, np.arange(len(ids), dtype=self.ranks.dtype)[None, :], axis=1)
        self._beyond, self._inside = np.empty_like(self.ranks), np.empty(order.shape, bool)
        self._widths = [FIRST_WIDTH]
        self._step = 0

    def collisions(self, own: np.ndarray, width: float) -> tuple[np.ndarray, bool]:
        """How many windows hold each vector, and whether all windows hold all vectors."""
        low = np.searchsorted(self.sorted, own - width)
        lengths = np.searchsorted(self.sorted, own + width, "right") - low
        kind = self.ranks.dtype
        np.subtract(self.ranks, (low - self.begins).astype(kind)[:, None], out=self._beyond)
        np.less(self._beyond, lengths.astype(kind)[:, None], out=self._inside)
        counts = self._inside.view(np.uint8).sum(axis=0, dtype=np.min_scalar_type(len(lengths)))
        return counts, lengths.min() == len(self.ids)

    def candidates(self, query_id: int, query: np.ndarray, enough: int = ENOUGH, share: float = COLLISIONS) -> np.ndarray:
        """Places of the other ids' vectors that collide often enough, in windows just wide enough for ``enough`` ids."""
        other = self.ids != query_id
        others = len(self.distinct) - int(query_id in self.distinct)
        enough = min(max(enough, int(ENOUGH_SHARE * len(self.distinct))), others)
        own = query / np.sqrt((query * query).sum()) @ self.directions + self.lift
        least = int(np.ceil(share * len(own)))

        def at(step: int) -> tuple[np.ndarray, bool]:
            while step >= len(self._widths):
                self._widths.append(self._widths[-1] * GROWTH)
            counts, covered = self.collisions(own, self._widths[step])
            found = np.flatnonzero((counts >= least) & other)
            return found, covered or len(found) >= enough and (
                self.single or len(np.unique(self.ids[found])) >= enough)

        # Wider windows hold all that narrower ones do, so the first wide enough is found from any step; the last query's
        # is mostly near.
        found, done = at(self._step)
        if done:
            while self._step and (narrower := at(self._step - 1))[1]:
                found, self._step = narrower[0], self._step - 1
        while not done:
            self._step += 1
            found, done = at(self._step)
        return found

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The best k of this block by score, then id, without the query's own id; one entry per id."""
        at = self.candidates(query_id, query)
        scores = cosines(self.vectors[at], self.norms[at], query, np.sqrt((query * query).sum()))
        if self.single and len(at) > k:
            near = scores >= np.partition(scores, -k)[-k]
            at, scores = at[near], scores[near]
        best: dict[int, float] = {}
        for i in np.lexsort([self.ids[at], -scores]):
            best.setdefault(int(self.ids[at[i]]), float(scores[i]))
            if len(best) == k:
                break
        return list(best.items())


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, each divided by a power of two, which changes no digit of a cosine: squares of very small or large
    components neither vanish nor overflow."""
    column = table.column("embedding").combine_chunks()
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return table.column("vec_id").to_numpy(), np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _search_block(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and queries.num_rows:
            index = BlockIndex(*_matrix(vectors))
            for query_id, query in zip(*_matrix(queries)):
                found += [(int(query_id), vec_id, score) for vec_id, score in index.search(int(query_id), query, k)]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()),
                         "vec_id": pa.array([f[1] for f in found], pa.int64()),
                         "score": pa.array([f[2] for f in found], pa.float64())})
    return search


def search(vectors: DataFrame, is_query: Column, k: int = 5, block_vectors: int = BLOCK_VECTORS,
           block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each row on which ``is_query`` (on vec_id) holds."""
    spark = vectors.sparkSession
    merged = usable(vectors).groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    rows = stored(merged.withColumn("place", F.monotonically_increasing_id()),
                  f"{work_folder(spark, 'neighbours')}/vectors")
    # The length of most vectors; others cannot be compared with them.
    usual = rows.groupBy(F.size("embedding").alias("size")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("copies"), "size").first()
    if usual is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("embedding") == usual["size"])
    count = usual["rows"]
    blocks = -(-count // block_vectors)
    query_blocks = max(1, -(-rows.where(is_query).count() // block_queries))
    # Every block of vectors meets every block of queries: both are copied under the number of the pair.
    spread = F.xxhash64("place")
    left = rows.withColumn("v", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = rows.where(is_query).withColumn("q", F.pmod(spread, F.lit(query_blocks)).cast("int")).withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))
    left, right = (side.select("v", "q", "vec_id", "embedding") for side in (left, right))
    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(
        _search_block(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
