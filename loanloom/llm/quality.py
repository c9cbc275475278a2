"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Statistics (shares of byte classes, lengths, repetition, entropy) are computed from the whole text. At most ``TRAINING_ROWS`` labelled documents, those with the smallest hashes of their ids, go to the driver as rows of
some thirty numbers; there the trees grow level by level from histograms over ``BINS`` quantile bins. All trees are laid
out in four arrays that tasks walk for a whole batch of documents at once.

Defined results: a null text counts as empty and gets a score like any other; labels other than 0 and 1 and rows without a
``doc_id`` teach nothing; without labels of both classes every score is the share of label 1 (0.5 without any); repeated
rows give repeated results; further columns are ignored; an empty table gives an empty result. Statistics cover a whole text of any length and
take some tens of bytes per byte of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_possible, mix, range_hashes, slices, stored, text_arrays, word_ranges, work_folder

# Only for annotations: it would take some 25 MB of every Python worker.
if TYPE_CHECKING:
    import pandas as pd

TRAINING_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
SMOOTHING = 1.0
LEAST_WEIGHT = 1.0
REJECT_BELOW = 0.3


# --- statistics -------------------------------------------------------------------------------------------------------

def _bytes(*ranges: tuple[int, int] | str) -> np.ndarray:
    mask = np.zeros(256, bool)
    for r in ranges:
        mask[list(r.encode()) if isinstance(r, str) else slice(r[0], r[1] + 1)] = True
    return mask


CLASSES = {
    "upper": _bytes((65, 90)), "lower": _bytes((97, 122)), "digit": _bytes((48, 57)), "high": _bytes((128, 255)),
    "blank": _bytes(" "), "newline": _bytes("\n"), "other_space": _bytes("\t\r\x0b\x0c"), "stop": _bytes("."),
    "comma": _bytes(","), "exclamation": _bytes("!"), "question": _bytes("?"), "currency": _bytes("$%"),
    "hash": _bytes("#"), "ampersand": _bytes("&"), "star": _bytes("*"), "bar": _bytes("|"), "angle": _bytes("<>"),
    "brackets": _bytes("()[]{}"), "slash": _bytes("/\\"), "equals": _bytes("=+-_~"), "at": _bytes("@"),
    "quotes": _bytes("\"'`"), "colon": _bytes(":;"), "control": _bytes((0, 8), (14, 31), (127, 127)),
}
_CLASS_MATRIX = np.stack([m.astype(np.float64) for m in CLASSES.values()], axis=1)
_NEWLINE = _bytes("\n")
FEATURES = [*CLASSES, "log_bytes", "log_words", "entropy", "mean_word", "longest_word", "distinct_words", "log_lines",
            "mean_line", "distinct_lines", "capital_words", "word_ends_odd", "most_common_byte"]


def _distinct_share(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes per text, as a share of its hashes."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    keys, at = np.unique(mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(text[at], minlength=len(counts)) / np.maximum(counts, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, offsets = text_arrays(texts)
    lengths = np.diff(offsets)
    count = len(lengths)
    size = np.maximum(lengths, 1)
    owner = np.repeat(np.arange(count) * 256, lengths)
    histogram = np.bincount(owner + data, minlength=count * 256).reshape(count, 256)
    shares = histogram / size[:, None]
    entropy = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(axis=1)

    starts, ends, first = word_ranges(data, offsets)
    word_owner = np.repeat(np.arange(count), np.diff(first))
    words = np.diff(first)
    word_lengths = ends - starts
    some = np.maximum(words, 1)
    longest = np.zeros(count)
    np.maximum.at(longest, word_owner, word_lengths)
    per_word = lambda flags: np.bincount(word_owner, weights=flags, minlength=count) / some
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    before_last = data[np.maximum(ends - 2, starts)] if len(ends) else last
    is_upper, is_plain = CLASSES["upper"], CLASSES["upper"] | CLASSES["lower"] | CLASSES["digit"] | CLASSES["high"]
    # Words of capitals: first and last letters both are, in words of two letters or more.
    capitals = is_upper[data[starts]] & is_upper[before_last] & (word_lengths > 1) if len(starts) else np.zeros(0)
    odd_ends = ~is_plain[last] & ~is_plain[before_last] & (word_lengths > 2) if len(starts) else np.zeros(0)

    line_starts, line_ends, first_line = word_ranges(data, offsets, _NEWLINE)
    lines = np.diff(first_line)
    columns = [shares @ _CLASS_MATRIX, np.stack([
        np.log1p(lengths), np.log1p(words), entropy, word_lengths_mean(word_lengths, word_owner, some), longest,
        _distinct_share(range_hashes(data, starts, ends), first), np.log1p(lines), lengths / np.maximum(lines, 1),
        _distinct_share(range_hashes(data, line_starts, line_ends), first_line), per_word(capitals), per_word(odd_ends),
        shares.max(axis=1)], axis=1)]
    return np.concatenate(columns, axis=1).astype(np.float32)


def word_lengths_mean(lengths: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.bincount(owner, weights=lengths, minlength=len(counts)) / counts


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = statistics(batch.column("text"))
        ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.ListArray.from_arrays(
            pa.array(ends), pa.array(rows.ravel()))})


# --- trees ------------------------------------------------------------------------------------------------------------

@dataclass
class Forest:
    """Trees as arrays of nodes: a node's children lie side by side, leaves point to themselves."""
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                right = rows[every, self.feature[node]] > self.threshold[node]
                node = self.child[node] + (right & (self.child[node] != node))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
                bins: int = BINS) -> Forest:
    """Boost trees on the logistic loss; every split is the best one over the bins' histograms."""
    count, width = rows.shape
    share = float(np.clip(labels.mean() if count else 0.5, 1e-3, 1 - 1e-3))
    feature, threshold, child, value, roots = [], [], [], [], []
    if not count or labels.min() == labels.max():
        whole = float(labels.mean()) if count else 0.5
        base = float(np.log(np.clip(whole, 1e-9, 1 - 1e-9) / (1 - np.clip(whole, 1e-9, 1 - 1e-9))))
        return Forest(*(np.zeros(0, int) for _ in range(5)), base, depth)
    edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(edges[k], rows[:, k], "left") for k in range(width)], axis=1)
    cell = binned + np.arange(width) * bins
    base = float(np.log(share / (1 - share)))
    margin = np.full(count, base)
    for _ in range(trees):
        probability = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - probability, probability * (1 - probability)
        roots.append(len(feature))
        feature.append(0), threshold.append(0.0), child.append(len(feature) - 1), value.append(0.0)
        node = np.full(count, roots[-1])
        level = [roots[-1]]
        for step in range(depth + 1):
            number = {n: i for i, n in enumerate(level)}
            place = np.full(len(feature), -1)
            place[level] = np.arange(len(level))
            slot = place[node]
            inside = slot >= 0
            flat = (slot[inside, None] * (width * bins) + cell[inside]).ravel()
            shape = (len(level), width, bins)
            g, h = (np.bincount(flat, weights=np.repeat(v[inside], width), minlength=len(level) * width * bins).reshape(shape)
                    for v in (gradient, weight))
            g_sum, h_sum = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
            next_level = []
            if step < depth:
                left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
                right_g, right_h = g_sum[:, None, None] - left_g, h_sum[:, None, None] - left_h
                gain = (left_g ** 2 / (left_h + SMOOTHING) + right_g ** 2 / (right_h + SMOOTHING)
                        - (g_sum ** 2 / (h_sum + SMOOTHING))[:, None, None])
                gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
            for n, i in number.items():
                value[n] = rate * g_sum[i] / (h_sum[i] + SMOOTHING)
                if step == depth:
                    continue
                best = int(gain[i].argmax())
                k, b = divmod(best, bins)
                if gain[i, k, b] <= 1e-6 or b >= len(edges[k]):
                    continue
                feature[n], threshold[n], child[n] = k, float(edges[k][b]), len(feature)
                for _ in range(2):
                    feature.append(0), threshold.append(0.0), child.append(len(feature) - 1), value.append(0.0)
                    next_level.append(len(feature) - 1)
                mine = node == n
                node[mine] = child[n] + (binned[mine, k] > b)
            if not next_level:
                break
            level = next_level
        margin += np.array(value)[node]
    return Forest(np.array(feature), np.array(threshold, np.float32), np.array(child), np.array(value), np.array(roots),
                  base, depth)


# --- operator ---------------------------------------------------------------------------------------------------------

def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def training_labels(labels: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, those with the smallest hashes. One row per id (the larger label wins)."""
    rows = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def training_sample(docs: DataFrame, known: DataFrame, features: Callable, ddl: str) -> pa.Table:
    """doc_id, label and features of the labelled documents, in a fixed order. ``features`` maps batches of doc_id and text
    to rows of ``ddl``; only the texts of these few documents reach it."""
    known = stored(known, f"{work_folder(docs.sparkSession, 'training')}/labels")
    key = F.md5(F.col("doc_id").cast("string")).alias("key")
    texts = keep_possible(docs.select("doc_id", "text", key), known.select(key), "key")
    texts = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text")
    rows = texts.mapInArrow(features, ddl).join(F.broadcast(known), "doc_id").toArrow()
    column = rows.column(1).combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))).tolist()
    ties = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
    rows = rows.append_column("tie", pa.array(ties, pa.int64()))
    return rows.sort_by([("doc_id", "ascending"), ("tie", "ascending")])


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Forest:
    """``docs`` has doc_id (long) and text, ``labels`` doc_id and quality."""
    known = training_labels(labels, "quality", remainder(F.col("doc_id"), 5) != 0, training_rows)
    sample = training_sample(docs, known, _statistics, "doc_id long, x array<float>")
    table = sample.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return grow_forest(table, sample.column("label").to_numpy().astype(float))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality."""
    docs = _columns(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, training_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(
                shared.value.score(statistics(batch.column("text"))))})

    return docs.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(_columns(docs), labels, training_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.score(statistics(batch.column(at))) >= REJECT_BELOW))

    return docs.mapInArrow(keep, docs.schema)


def metrics(scored: pd.DataFrame, labels: pd.DataFrame, label: str) -> dict[str, float]:
    """Accuracy, precision and recall of ``predicted`` on held-out rows."""
    rows = scored[scored.held_out].merge(labels[["doc_id", label]].dropna(), on="doc_id")
    hit = int(((rows.predicted == 1) & (rows[label] == 1)).sum())
    return {"rows": len(rows), "accuracy": float((rows.predicted == rows[label]).mean()),
            "precision": hit / max(1, int((rows.predicted == 1).sum())), "recall": hit / max(1, int((rows[label] == 1).sum()))}
