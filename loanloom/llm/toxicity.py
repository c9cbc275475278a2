"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms, each with the value 1: words (runs of ASCII letters and digits and of non-ASCII
bytes, lower-cased) and, of longer words, their first ``PREFIX`` bytes. The score adds a bias, one weight per term and, for every pair of terms, the dot product of their factors, so
that two terms can matter together which mean little apart. Pairs are never listed: their sum is half of the square of the
factors' sum less the sum of their squares.

At most ``TRAINING_ROWS`` labelled documents, those with the smallest hashes of their ids, go to the driver as sets of term
numbers; terms seen in fewer than ``LEAST_DOCUMENTS`` of them get no weight. AdaGrad fits the model there, from the log-odds
of the terms that clearly go with one label. Scoring walks the
whole text of every document once; the model's size is fixed by ``BUCKETS`` and ``FACTORS``.

Defined results: a null text counts as empty; a document without known terms gets the bias' score; labels other than 0 and 1
and rows without a ``doc_id`` teach nothing; without labels of both classes every score is the share of label 1 (0.5 without
any); repeated rows give repeated results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mix, range_hashes, slices, text_arrays, word_ranges
from .quality import remainder, training_labels, training_sample

BUCKETS = 1 << 18
FACTORS = 4
TRAINING_ROWS = 20_000
PREFIX = 5
LEAST_DOCUMENTS = 4
# A term starts with a share of its log-odds if those are at least so large and so unlikely to be chance (G statistic).
START_SHARE, START_ODDS, START_G = 0.7, 1.5, 15.0
ROUNDS = 5
BATCH = 128
RATE = 0.1
DECAY = 1e-4
TOXIC_FROM = 0.7

_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
for _first, _last in ("09", "az", "AZ"):
    _BETWEEN[ord(_first):ord(_last) + 1] = False


# --- terms ------------------------------------------------------------------------------------------------------------

def term_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's terms, one text after the other, and where each begins, with the end."""
    data, offsets = text_arrays(texts)
    data = lower_ascii(data)
    starts, ends, first = word_ranges(data, offsets, _BETWEEN)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    long = ends - starts > PREFIX
    hashes = np.concatenate([range_hashes(data, starts, ends),
                             mix(range_hashes(data, starts[long], starts[long] + PREFIX) + np.uint64(1))])
    buckets = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    keys = np.unique(np.concatenate([owner, owner[long]]) * BUCKETS + buckets)
    return keys & (BUCKETS - 1), np.searchsorted(keys, np.arange(len(offsets)) * BUCKETS)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        terms, offsets = term_sets(batch.column("text"))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "terms": pa.ListArray.from_arrays(
            pa.array(offsets.astype(np.int32)), pa.array(terms.astype(np.int32)))})


# --- model ------------------------------------------------------------------------------------------------------------

@dataclass
class Machine:
    """number: row of each bucket in the tables below, 0 for buckets without a weight (that row is zero)."""
    number: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = self.number[terms]
        rows, ends = rows[rows > 0], np.append(0, np.cumsum(rows > 0))[offsets]
        return 1 / (1 + np.exp(-np.clip(self.margin(rows, ends)[0], -50, 50)))

    def margin(self, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and each document's sum of factors."""
        own = self.factors[rows]
        linear = _sums(self.weight[rows], ends)
        total = _sums(own, ends)
        return self.bias + linear + 0.5 * ((total ** 2) - _sums(own ** 2, ends)).sum(axis=1), total


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive ends."""
    sums = np.concatenate([np.zeros_like(values[:1], shape=(1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return sums[ends[1:]] - sums[ends[:-1]]


def starting_weights(ones: np.ndarray, zeros: np.ndarray, share: float) -> np.ndarray:
    """Weights from how many documents of each label hold a term."""
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)
    both = ones + zeros
    g = 2 * (part(ones, both * share) + part(zeros, both * (1 - share)))
    odds = np.log((ones + 0.5) / (zeros + 0.5)) - np.log(share / (1 - share))
    return np.where((g >= START_G) & (np.abs(odds) >= START_ODDS), START_SHARE * odds, 0.0)


def fit(terms: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, least: int = LEAST_DOCUMENTS,
        factors: int = FACTORS, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss over batches of documents in a fixed random order."""
    count = len(labels)
    random = np.random.default_rng(seed)
    seen = np.bincount(terms, minlength=BUCKETS)
    number = np.where(seen >= least, np.cumsum(seen >= least), 0).astype(np.int32)
    size = int(number.max()) + 1
    share = float(labels.mean()) if count else 0.5
    if not count or labels.min() == labels.max():
        bound = float(np.clip(share, 1e-9, 1 - 1e-9))
        return Machine(np.zeros(BUCKETS, np.int64), np.zeros(1), np.zeros((1, factors)), float(np.log(bound / (1 - bound))))
    model = Machine(number, np.zeros(size), random.normal(0, 0.01, (size, factors)), float(np.log(share / (1 - share))))
    model.factors[0] = 0
    known = number[terms]
    is_one = np.repeat(labels == 1, np.diff(offsets))
    ones, zeros = (np.bincount(known[flags], minlength=size) for flags in (is_one, ~is_one))
    model.weight[1:] = starting_weights(ones, zeros, share)[1:]
    ends = np.append(0, np.cumsum(known > 0))[offsets]
    known = known[known > 0]
    squares_w, squares_v, square_b = np.full(size, 1e-1), np.full((size, factors), 1e-1), 1e-1
    for _ in range(rounds):
        order = random.permutation(count)
        for begin in range(0, count, BATCH):
            docs = order[begin:begin + BATCH]
            lengths = ends[docs + 1] - ends[docs]
            own_ends = np.append(0, np.cumsum(lengths))
            at = np.repeat(ends[docs] - own_ends[:-1], lengths) + np.arange(own_ends[-1])
            rows = known[at]
            margin, total = model.margin(rows, own_ends)
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[docs]) / len(docs)
            per_term = np.repeat(error, lengths)
            touched, place = np.unique(rows, return_inverse=True)
            gradient = np.bincount(place, weights=per_term, minlength=len(touched)) + decay * model.weight[touched]
            squares_w[touched] += gradient ** 2
            change_v = (np.repeat(total, lengths, axis=0) - model.factors[rows]) * per_term[:, None]
            gradient_v = np.stack([np.bincount(place, weights=change_v[:, k], minlength=len(touched))
                                   for k in range(factors)], axis=1) + decay * model.factors[touched]
            squares_v[touched] += gradient_v ** 2
            model.weight[touched] -= rate * gradient / np.sqrt(squares_w[touched])
            model.factors[touched] -= 0.2 * rate * gradient_v / np.sqrt(squares_v[touched])
            square_b += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(square_b)
    return model


# --- operator ---------------------------------------------------------------------------------------------------------

def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Machine:
    """``docs`` has doc_id (long) and text, ``labels`` doc_id and toxic."""
    known = training_labels(labels, "toxic", remainder(F.col("doc_id"), 3) != 1, training_rows)
    sample = training_sample(docs, known, _terms, "doc_id long, terms array<int>")
    column = sample.column("terms").combine_chunks()
    offsets = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
    return fit(column.flatten().to_numpy(zero_copy_only=False), offsets, sample.column("label").to_numpy().astype(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and toxic."""
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, training_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(
                shared.value.score(*term_sets(batch.column("text"))))})

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
