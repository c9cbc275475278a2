"""Pack documents into sequences of fixed length by cutting-stock column generation.

A document's ids are cut into full pieces of ``CAPACITY`` and one shorter tail. The histogram over classes of lengths (at
most some 200 numbers, whatever the input's size) goes to the driver: a linear program over patterns, i.e. ways to fill one
sequence. New patterns come from a knapsack solved by dynamic programming over the program's prices, until a bound shows
that no more than ``GAP`` can be gained. The solution is rounded down, and first-fit decreasing packs the few classes left
over. Lengths up to ``SHORT`` are classes of their own: short pieces are first packed into bundles of ``BUNDLE`` ids by the
same program, and bundles then count as pieces. Longer ones are rounded up to ``UNIT`` ids, above 512 to twice that.

Each piece then finds its place from its rank within its class: ranks are counted in the encoding tasks, and counts per
task and class put tasks in order, so no task ever sorts a whole class. Patterns own ranges of ranks, so a binary search
in a table of bounded size gives sequence and slot.

Defined results: null text is empty and has the end id alone; repeated rows are packed each by itself; further columns are
ignored; an empty table gives an empty result. A long text is encoded as a whole and fills sequences of its own but for its
tail.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, work_folder
from .token_files import with_end
from .tokens import encoder

CAPACITY = 2048
UNIT = 8
SHORT, BUNDLE = 64, 256
# Column generation ends once the bound shows that at most this share of sequences could still be saved.
GAP = 0.001

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, own_rank long")


# --- pieces -----------------------------------------------------------------------------------------------------------

def cut(offsets: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece: full pieces, then the tail."""
    tokens = np.diff(offsets)
    counts = -(-tokens // capacity)
    document = np.repeat(np.arange(len(tokens)), counts)
    number = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = number * capacity
    return document, start, np.minimum(capacity, tokens[document] - start)


def length_classes(lengths: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """The room that pieces take: their class."""
    step = np.where(lengths > 512, 2 * unit, unit)
    return np.where(lengths <= SHORT, lengths, -(-lengths // step) * step)


def _pieces(path: str, end: int, capacity: int, unit: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 2 * unit, np.int64)
        for batch in slices(batches):
            ids, offsets = with_end(*own.encode(batch.column("text")), end)
            document, start, length = cut(offsets, capacity)
            kind = np.minimum(length_classes(length, unit), capacity)
            order = np.argsort(kind, kind="stable")
            counts = np.bincount(kind, minlength=len(ranks))
            within = np.empty(len(kind), np.int64)
            within[order] = np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts)
            raw = memoryview(ids.astype("<u4")).cast("B")
            begins = (offsets[document] + start) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(begins.tolist(), (begins + 4 * length).tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(document)), "start": pa.array(start),
                "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": pa.array(np.diff(offsets)[document]),
                "part": pa.array(np.full(len(kind), part, np.int32)), "class": pa.array(kind.astype(np.int32)),
                "own_rank": pa.array(ranks[kind] + within)})
            ranks += counts
    return pieces


def tokenised_pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """The pieces of all documents (doc_id, text) with lengths, checksums and ranks."""
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(path, end, capacity, unit), PIECES)


# --- patterns ---------------------------------------------------------------------------------------------------------

def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: how many of each size fill ``room`` at the highest total price."""
    useful = np.flatnonzero(prices > 1e-12)
    pattern = np.zeros(len(sizes), np.int64)
    if not len(useful):
        return 0.0, pattern
    own, price = sizes[useful], prices[useful]  # in ascending order
    fitting = np.searchsorted(own, np.arange(room + 1), "right").tolist()
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for width in range(int(own[0]), room + 1):
        value[width] = value[width - 1]
        totals = value[width - own[:fitting[width]]] + price[:fitting[width]]
        k = int(totals.argmax())
        if totals[k] > value[width] + 1e-12:
            value[width], choice[width] = totals[k], k
    width = room
    while width > 0:
        if choice[width] < 0:
            width -= 1
        else:
            pattern[useful[choice[width]]] += 1
            width -= own[choice[width]]
    return float(value[room]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in an optimal fractional solution, by column generation.

    Revised simplex: the basis has one pattern per size, the first ones hold a single size.
    """
    count = len(sizes)
    patterns = np.diag(room // sizes)
    inverse = np.diag(1.0 / (room // sizes))
    used = demand / (room // sizes)
    for _ in range(100 * count):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, room)
        if value <= 1 + 1e-9 or prices @ demand / value >= (1 - gap) * used.sum():
            break
        direction = inverse @ pattern
        ratios = np.where(direction > 1e-10, used / np.where(direction > 1e-10, direction, 1), np.inf)
        leaves = int(ratios.argmin())
        step = ratios[leaves]
        used = np.maximum(used - step * direction, 0)
        used[leaves] = step
        patterns[leaves] = pattern
        inverse[leaves] /= direction[leaves]
        others = direction.copy()
        others[leaves] = 0
        inverse -= np.outer(others, inverse[leaves])
    return patterns, used


def plan(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how many sequences follow each; together they hold exactly ``demand``."""
    if not len(sizes):
        return []
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    patterns, used = solve_patterns(sizes, demand.astype(float), room, gap)
    chosen: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    for pattern, times in zip(patterns, np.floor(used + 1e-9).astype(np.int64)):
        inside = pattern > 0
        times = min(int(times), int((left[inside] // pattern[inside]).min()))
        if times > 0:
            chosen.append((pattern.copy(), times))
            left -= pattern * times
    while left.any():  # first-fit decreasing, many equal sequences at a time
        pattern, free = np.zeros(len(sizes), np.int64), room
        for k in np.argsort(-sizes):
            pattern[k] = min(left[k], free // sizes[k])
            free -= pattern[k] * sizes[k]
        inside = pattern > 0
        times = int((left[inside] // pattern[inside]).min())
        chosen.append((pattern, times))
        left -= pattern * times
    return chosen


def _ranges(sizes: np.ndarray, chosen: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """By class, rows (first rank, first sequence, pieces of this class in each of the pattern's sequences)."""
    table: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    next_rank = {int(s): 0 for s in sizes}
    sequence = 0
    for pattern, times in chosen:
        for k in np.flatnonzero(pattern):
            size = int(sizes[k])
            table[size].append((next_rank[size], sequence, int(pattern[k])))
            next_rank[size] += int(pattern[k]) * times
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in table.items()}


def _found(rows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The sequence, or bundle, of each rank of one class."""
    own = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
    return own[:, 1] + (rank - own[:, 0]) // own[:, 2]


class Layout:
    """Which sequence each piece lies in, by class and rank."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT, gap: float = GAP):
        sizes = np.array(sorted(histogram), np.int64)
        demand = np.array([histogram[int(s)] for s in sizes], np.int64)
        short = (sizes <= SHORT) & (capacity % BUNDLE == 0)
        bundles = plan(sizes[short], demand[short], BUNDLE, gap)
        self.bundled = _ranges(sizes[short], bundles)
        # Bundles rank behind the pieces of their size.
        self.first_bundle = int(histogram.get(BUNDLE, 0))
        long = {int(s): int(d) for s, d in zip(sizes[~short], demand[~short])}
        if count := sum(times for _, times in bundles):
            long[BUNDLE] = self.first_bundle + count
        sizes = np.array(sorted(long), np.int64)
        by = int(np.gcd.reduce(np.append(sizes, capacity)))
        chosen = plan(sizes // by, np.array([long[int(s)] for s in sizes], np.int64), capacity // by, gap)
        self.ranges = _ranges(sizes, chosen)

    def sequences(self, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        sequence = np.empty(len(rank), np.int64)
        for k in np.unique(kind).tolist():
            at, size = np.flatnonzero(kind == k), k
            found = rank[at]
            if k in self.bundled:
                found, size = self.first_bundle + _found(self.bundled[k], found), BUNDLE
            sequence[at] = _found(self.ranges[size], found)
        return sequence


def _assign(layout: Layout):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence = layout.sequences(batch.column("class").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)],
                                             names=[*batch.schema.names, "sequence_id"])
    return assign


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Give each stored piece its sequence_id and offset. The columns are those of ``PIECES``."""
    counts = pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("pieces"))
    histogram = {r["class"]: r["pieces"] for r in counts.groupBy("class").agg(F.sum("pieces").alias("pieces")).collect()}
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "class", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "class"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
        (F.col("before") + F.col("own_rank")).alias("rank"))
    placed = ranked.mapInArrow(_assign(Layout(histogram, capacity, unit)),
                               "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, "
                               "rank long, sequence_id long")
    # A sequence has at most ``capacity`` pieces, of different ranks or classes.
    within = (Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    pieces = stored(tokenised_pieces(docs, path, end, capacity, unit), f"{work_folder(spark, 'packing')}/pieces")
    return pack(pieces, capacity, unit)


def sequences(packed: DataFrame, ids: DataFrame, capacity: int = CAPACITY, padding: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to ``capacity`` unless their number is a power of two. ``ids`` has doc_id (unique)
    and ids of whole documents with their end id."""
    cut_out = packed.join(ids, "doc_id").select("sequence_id", F.struct(
        "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("piece"))
    whole = cut_out.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))
    power = F.expr("bit_count(size(ids)) = 1")
    padded = F.concat("ids", F.array_repeat(F.lit(padding), F.lit(capacity) - F.size("ids")))
    return whole.select("sequence_id", F.when(power, F.col("ids")).otherwise(padded).alias("ids"))
