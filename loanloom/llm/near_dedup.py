"""Near duplicates by MinHash bands, odd sketches and full sets.

A document's set is its distinct five-word shingles as 64-bit hashes. Documents with equal sets form a class, and one
member stands for it. Each class has ``BANDS`` band keys of ``ROWS`` MinHash values and an odd sketch: a bitmap in which
every MinHash sample flips one bit, so that equal samples of two documents cancel and the population count of the XOR of
their bitmaps tells how many samples differ. At a similarity of 0.75 two documents share no band with probability 2e-4.

Buckets of up to ``SMALL`` members give all their pairs, larger ones (of some bands) the pairs of one member with all others. Pairs go on if
their odd sketches do not rule the threshold out (by six standard deviations), and are linked if the full sets confirm it.
Every document's most similar partners are confirmed first; components are found, and of the other pairs only those between
different components are looked at. Larger buckets whose members are not all in one component by then are compared in chunks,
members outside the main component with all others, again by odd sketches before the full sets (see ``links``). So no link
within a bucket is lost, no bucket becomes a single task, and a bucket of connected copies costs one pair per member.

Defined results: null text is empty; an empty set is linked with nothing; a text of fewer than five words is one shingle;
a row without ``doc_id`` is linked with nothing, has no component and is kept; rows that share a ``doc_id`` count as one
document, linked through any of its texts; an empty table gives an empty result; further columns are ignored. A text is hashed as a
whole, which takes some tens of bytes per byte of the text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import (finished, keep_possible, lower_ascii, mix, range_hashes, slices, stored, text_arrays, word_ranges,
                     work_folder)
from .links import chunk_links, components, shared_ids, unsettled, with_components

WORDS = 5
BANDS, ROWS = 32, 5
SKETCH_BITS = 512
SMALL = 64
# Members of a larger bucket that are compared with as many others in one task.
CHUNK = 512
# How many of its most similar partners each document is compared with before components are first found.
BEST = 3
# Bands whose large buckets give pairs with their leaders: these only spare the chunks work, which find all links.
LEADING = 8
# Similarity in percent.
THRESHOLD = 75

_SAMPLES = BANDS * ROWS
_SEEDS = np.random.default_rng(20240229).integers(1 << 63, size=(3, _SAMPLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = (_SEEDS[0] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MASKS = (_SEEDS[1] >> np.uint64(32)).astype(np.uint32)
_PLACES = np.random.default_rng(5).integers(1 << 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


# --- sets and sketches ------------------------------------------------------------------------------------------------

def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_arrays(texts)
    data = lower_ascii(data)
    starts, ends, first = word_ranges(data, offsets)
    hashes = range_hashes(data, starts, ends)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for j in range(words):
        rolled += hashes[j:j + len(rolled)] * _PLACES[j]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            yield np.unique(rolled[a:b - words + 1])
        elif b > a:
            short = (hashes[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """One MinHash value per sample."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(_SAMPLES, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(values), 128):
        block = (values[begin:begin + 128, None] ^ _MASKS) * _FACTORS
        np.minimum(least, block.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    own = mix(samples.astype(np.uint64) + _SEEDS[2]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mix(own + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    bits = mix(samples.astype(np.uint64) * np.uint64(2) + _SEEDS[0]) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing_bits(threshold: int = THRESHOLD) -> int:
    """Bits in which the sketches of two documents at the threshold may differ, six standard deviations above the mean:
    of the number of samples that differ, and of the flips that meet in one bit and cancel."""
    distance = 1 - threshold / 100
    flips = 2 * _SAMPLES * distance
    slope = math.exp(-2 * flips / SKETCH_BITS)
    samples = (2 * slope) ** 2 * _SAMPLES * distance * (1 - distance)
    cancelled = 2 * flips ** 2 / SKETCH_BITS
    return min(SKETCH_BITS, math.ceil(SKETCH_BITS / 2 * (1 - slope) + 6 * math.sqrt(samples + cancelled)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, digests, bands, sketches = [], [], [], []
        for shingles in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None)
            samples = min_hashes(shingles)
            bands.append(band_keys(samples))
            sketches.append(odd_sketch(samples))
        bits = np.stack(sketches)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.string()),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, (len(bands) + 1) * BANDS, BANDS, dtype=np.int32)),
                                              pa.array(np.concatenate(bands))),
            **{name: pa.array(np.ascontiguousarray(bits[:, i])) for i, name in enumerate(_SKETCH)}})


_SKETCH_ROWS = "doc_id long, n_shingles long, digest string, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"))]
        ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))})


# --- pairs ------------------------------------------------------------------------------------------------------------

def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _hex(column: str):
    """A hex digest of an id, for the bounded filter."""
    return F.md5(F.col(column).cast("string"))


def likely(classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """a, b, bits of the pairs whose odd sketches do not rule the threshold out."""
    side = {x: classes.select(F.col("head").alias(x), *[F.col(s).alias(f"{x}_{s}") for s in _SKETCH]) for x in "ab"}
    differing = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _SKETCH), F.lit(0))
    both = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", differing.alias("bits"))
    return both.where(F.col("bits") <= most_differing_bits(threshold)).groupBy("a", "b").agg(F.min("bits").alias("bits"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles of the documents in ``wanted``; other texts are neither moved nor cut up."""
    wanted = wanted.select("doc_id", _hex("doc_id").alias("key"))
    texts = keep_possible(docs.select("doc_id", "text", _hex("doc_id").alias("key")), wanted, "key")
    return texts.join(wanted, ["doc_id", "key"], "left_semi").select("doc_id", "text").mapInArrow(
        _sets, "doc_id long, shingles array<long>")


def confirmed(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = (pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set")), "b"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    linked = both.where(100 * shared >= threshold * (F.size("a_set") + F.size("b_set") - shared))
    return linked.select("a", "b").distinct()


def between_components(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not known to be connected."""
    a, b = (found.select(F.col("doc_id").alias(x), F.col("component_id").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "bits")


def best_partners(pairs: DataFrame, count: int) -> DataFrame:
    """The pairs that are among the ``count`` most similar of one of their ends."""
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "bits").unionByName(
        pairs.select(F.col("b").alias("x"), "a", "b", "bits"))
    order = Window.partitionBy("x").orderBy("bits", "a", "b")
    return ends.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).select(
        "a", "b", "bits").distinct()


def _bucket_pairs(members: DataFrame, small: int) -> DataFrame:
    """All pairs (a, b) of small buckets, those with the leader of large ones in the first bands."""
    few = (members.where(F.col("members") <= small).groupBy("bucket")
           .agg(F.sort_array(F.collect_list("doc_id")).alias("ids")))
    few = few.select(F.posexplode("ids").alias("at", "a"), "ids").select("a", F.explode(
        F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
    led = members.where((F.col("members") > small) & (F.col("band") < LEADING))
    return few.unionByName(led.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))


def unlike(sketches: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of rows of ``sketches`` rule the threshold out."""
    bits = np.zeros((len(sketches), len(sketches)), np.uint16)
    for column in sketches.T.view(np.uint64):
        bits += np.bitwise_count(column[:, None] ^ column[None, :])
    return bits > most_differing_bits(threshold)


def _linked(docs: DataFrame, rows: DataFrame, classes: DataFrame, folder: str, threshold: int, small: int) -> DataFrame:
    """doc_id, component_id of the documents that are linked with others."""
    bands = classes.select(F.col("head").alias("doc_id"), F.posexplode("bands").alias("band", "bucket"))
    # Any member can lead; it differs between buckets.
    buckets = bands.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct(F.xxhash64("doc_id", "bucket").alias("hash"), "doc_id")).alias("first")).where("members > 1")
    members = stored(bands.join(buckets, "bucket").select(
        "bucket", "band", "doc_id", "members", F.col("first.doc_id").alias("leader")), f"{folder}/members")
    pairs = stored(likely(classes, _ordered(_bucket_pairs(members, small)), threshold), f"{folder}/pairs")
    many = members.where(F.col("members") > small).select("bucket", "doc_id")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(many.select("doc_id")).distinct()
    sets = stored(full_sets(docs, wanted), f"{folder}/sets")

    best = stored(best_partners(pairs, BEST), f"{folder}/best")
    links = confirmed(sets, best, threshold).unionByName(shared_ids(rows, classes))
    found = components(stored(links, f"{folder}/links"), f"{folder}/first")
    others = between_components(pairs.join(best.select("a", "b"), ["a", "b"], "left_anti"), found)
    more = confirmed(sets, stored(others, f"{folder}/others"), threshold)
    sketches = classes.select(F.col("head").alias("doc_id"), *_SKETCH)
    chunks = unsettled(many, found, folder).join(sketches, "doc_id")
    more = more.unionByName(chunk_links(chunks, sets, threshold, _SKETCH, unlike, CHUNK))
    count = Observation()
    more = stored(more.observe(count, F.count(F.lit(1)).alias("links")), f"{folder}/more")
    if not count.get["links"]:
        return found
    known = found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    return components(known.unionByName(more), f"{folder}/last")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (columns doc_id and text)."""
    folder = work_folder(docs.sparkSession, "near")
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    rows = stored(docs.mapInArrow(_sketches, _SKETCH_ROWS), f"{folder}/sketches")
    linkable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # The class's smallest document stands for it; its bands come along.
    first = linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", *_SKETCH)).alias("first"))
    first = first.select("digest", F.col("first.doc_id").alias("head"), "first.bands", *[f"first.{s}" for s in _SKETCH])
    classes = stored(first, f"{folder}/classes")
    slim = rows.select("doc_id", "n_shingles", "digest")
    found = _linked(docs, slim, classes, folder, threshold, small)
    out = with_components(slim, classes, found).drop("digest")
    return finished(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), folder)


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the documents for which another one of their component stays, with all columns."""
    dropped = near_duplicates(docs, threshold).where("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["`doc_id`"].cast("long") == dropped["dropped_id"], "left_anti")
