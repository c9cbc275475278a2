"""Spelling variants of a corpus' words, by a trie kept as a table of edges.

All words of the corpus are counted. Those that stay make two tries, of the words read forwards and backwards, stored as
edges (node, letter, child); a node is the hash of what it spells. Two words that differ by one code point agree up to the
middle of either from one of the two ends, so a word starts in both tries at the node of its first half (no node near a
root, with its many children, is ever visited) and goes on from there. Its states (word, node, goal) form a frontier that is
joined with the edges of one depth after the other. A state without an edit either follows its word's next letter or makes
the edit that an edge asks for, and from then on knows its goal, the one word it can still become; a state with an edit
follows its goal. A state that has spelled its goal where a word ends is a neighbour. An edge also has 64 bits, one set for
each ending that words have below it, by hash, so that most states whose goal is no word end where they are made. The join
is keyed by node on both sides, and Spark splits a node that many words pass. Words of more than ``LONGEST`` code points
would need as many levels; they meet by the hashes of themselves without each of their code points instead, which finds the
same neighbours.

Forms are followed to the last by pointer jumping; a form's count is ten times its word's, so chains are short.

Defined results: a null or empty text has no words; without a ``doc_id`` nothing is deleted from a row's words; repeated
rows count repeatedly; a text may be one word of any length, whose hashes take some tens of bytes per code point; words
without a near word have n_near 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import finished, mix, stored, work_folder

LETTERS = r"[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
# One of so many runs, by hash, loses a letter.
DELETE_ONE_IN = 31
# A near word is a word's form if it occurs so many times as often.
DOMINANCE = 10
# Code points of the longest word in the tries.
LONGEST = 40

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, one row per occurrence: runs of letters with ``A-Z`` lower-cased, some of them without one letter."""
    text = F.translate(F.col("`text`").cast("string"), ascii_uppercase, ascii_lowercase)
    runs = docs.select(F.col("`doc_id`").cast("string").alias("doc_id"),
                       F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    # A deletion only shortens a run.
    runs = runs.where(F.char_length("run") >= least_length)
    hashed = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    place = (F.col("hash") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), place),
                       F.substring(F.col("run"), place + 2, F.char_length("run")))
    word = F.when(F.col("hash") % DELETE_ONE_IN == 0, shorter).otherwise(F.col("run"))
    return runs.withColumn("hash", hashed).select(word.alias("word")).where(F.char_length("word") >= least_length)


# --- the tries --------------------------------------------------------------------------------------------------------

def _node(text: Column, depth: Column | int, backwards: Column) -> Column:
    return F.xxhash64(F.substring(text, F.lit(1), F.lit(depth)), backwards)


def _from(text: Column, at: Column | int) -> Column:
    """What follows the first ``at`` code points."""
    return F.substring(text, F.lit(at) + 1, F.lit(LONGEST + 1))


def _letter(text: Column, at: Column | int) -> Column:
    return F.substring(text, F.lit(at) + 1, F.lit(1))


def _bit(ending: Column) -> Column:
    return F.pmod(F.xxhash64(ending), F.lit(64)).cast("int")


def _both_ways(words: DataFrame) -> DataFrame:
    """text, backwards, size: each word as the two tries spell it."""
    ways = F.array(F.struct(F.col("word").alias("text"), F.lit(False).alias("backwards")),
                   F.struct(F.reverse("word").alias("text"), F.lit(True).alias("backwards")))
    return words.select(F.inline(ways)).withColumn("size", F.char_length("text"))


def edges(words: DataFrame) -> DataFrame:
    """depth, node, letter, child, is_word, endings: the lower halves of the two tries, where alone a frontier passes."""
    size, depth = F.col("size"), F.col("depth")
    text, backwards = F.col("text"), F.col("backwards")
    steps = _both_ways(words).withColumn("depth", F.explode(F.sequence(((size - 1) / 2).cast("int"), size - 1)))
    ending = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(_from(text, depth + 1)))
    return (steps.select("depth", _node(text, depth, backwards).alias("node"), _letter(text, depth).alias("letter"),
                         _node(text, depth + 1, backwards).alias("child"), (depth + 1 == size).alias("is_word"),
                         ending.alias("ending"))
            .groupBy("depth", "node", "letter", "child").agg(F.max("is_word").alias("is_word"), F.bit_or("ending").alias("endings")))


def start(words: DataFrame, depth: int) -> DataFrame:
    """The states of the words that set out at ``depth``: forwards behind the first half, backwards behind the rest."""
    half = (F.col("size") / 2).cast("int")
    at = F.when(F.col("backwards"), F.col("size") - half).otherwise(half)
    return _both_ways(words).where(at == depth).select(
        "text", "backwards", _node(F.col("text"), depth, F.col("backwards")).alias("node"), F.lit(None).cast("string").alias("goal"))


def advance(frontier: DataFrame, trie: DataFrame, depth: int) -> DataFrame:
    """The states of ``frontier`` (text, backwards, node, goal) one level below ``depth``, with ``arrived`` where one has
    spelled its goal and a word ends there."""
    text, goal, letter, is_word = F.col("text"), F.col("goal"), F.col("letter"), F.col("is_word")
    size = F.char_length(text)
    head, own = F.substring(text, F.lit(1), F.lit(depth)), _letter(text, depth)
    # What is left behind the edge does not depend on it: after an exchange, an insertion and a deletion, or of the goal.
    left = F.when(goal.isNull(), _bit(_from(text, depth + 1)) + 64 * _bit(_from(text, depth)) + 4096 * _bit(_from(text, depth + 2))
                  ).otherwise(_bit(_from(goal, depth + 1)))
    rows = frontier.withColumn("left", left).join(trie.where(F.col("depth") == depth).drop("depth"), "node")

    def ends(way: int) -> Column:
        return F.getbit(F.col("endings"), F.shiftright("left", 6 * way).bitwiseAND(63)) == 1

    def to(goal: Column, arrived: Column) -> Column:
        return F.struct(goal.alias("goal"), arrived.alias("arrived"))

    def edited(goal: Column) -> Column:
        return to(goal, (F.char_length(goal) == depth + 1) & is_word)

    plain, inside, follows = goal.isNull(), size > depth, letter == own
    along, off = plain & inside & follows, plain & ~(inside & follows)
    moves = F.array(
        # Along the own letter; with the edge's letter in place of it; or along the goal.
        F.when(along, to(F.lit(None).cast("string"), F.lit(False)))
        .when(off & inside & ends(0), edited(F.concat(head, letter, _from(text, depth + 1))))
        .when(~plain & (letter == _letter(goal, depth)) & ends(0), edited(goal)),
        # The own word without its last letter ends here; or with the edge's letter in front of the own one.
        F.when(along & (size == depth + 2) & is_word, to(F.concat(head, letter), F.lit(True)))
        .when(off & ends(1), edited(F.concat(head, letter, _from(text, depth)))),
        # Without the own letter.
        F.when(off & inside & (letter == _letter(text, depth + 1)) & ends(2), edited(F.concat(head, _from(text, depth + 1)))))
    moved = rows.select("text", "backwards", F.col("child").alias("node"), F.explode(moves).alias("move"))
    moved = moved.where("move IS NOT NULL").select("text", "backwards", "node", "move.goal", "move.arrived")
    # A goal that is spelled but no word leads nowhere.
    return moved.where(F.col("arrived") | F.col("goal").isNull() | (F.char_length("goal") > depth + 1))


def _as_word(text: str) -> Column:
    return F.when(F.col("backwards"), F.reverse(text)).otherwise(F.col(text))


def trie_neighbours(words: DataFrame, shortest: int, longest: int, folder: str) -> DataFrame:
    """word, near: all words within one edit of each other; they have ``shortest`` to ``longest`` code points."""
    # By depth within each file, so that a level reads only its own edges.
    trie = stored(edges(words).sortWithinPartitions("depth"), f"{folder}/edges")
    before, found = None, words.select("word", F.lit(None).cast("string").alias("near")).limit(0)
    for depth in range(shortest // 2, longest):
        frontier = start(words, depth)
        frontier = frontier if before is None else frontier.unionByName(before)
        moved = stored(advance(frontier, trie, depth), f"{folder}/level{depth}")
        found = found.unionByName(moved.where("arrived").select(_as_word("text").alias("word"), _as_word("goal").alias("near")))
        before = moved.where("NOT arrived").drop("arrived")
    return found


# --- words too long for the tries -------------------------------------------------------------------------------------

def deletion_hashes(word: str) -> np.ndarray:
    """The hash of ``word``, and of what is left of it without each of its code points in turn."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.full(len(codes), _MULTIPLIER, np.uint64)
    powers[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(powers), dtype=np.uint64)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
    lengths = np.full(len(without), len(codes) - 1, np.uint64)
    return mix(np.append(sums[-1], without) + np.append(np.uint64(len(codes)), lengths) * np.uint64(0xD6E8FEB86659FD93))


def _deletion_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for word_id, word in zip(batch.column("id").to_pylist(), batch.column("word")):
            hashes, first = np.unique(deletion_hashes(word.as_py()), return_index=True)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(hashes.view(np.int64)), "id": pa.array(np.full(len(hashes), word_id)),
                "is_whole": pa.array(first == 0)})


def long_neighbours(words: DataFrame) -> DataFrame:
    """word, near of words of at least ``LONGEST`` code points: equal once one of them, or both, lose a code point."""
    words = words.select(F.xxhash64("word").alias("id"), "word")
    keys = words.mapInArrow(_deletion_rows, "key long, id long, is_whole boolean")
    other = keys.select("key", F.col("id").alias("near_id"), F.col("is_whole").alias("near_is_whole"))
    pairs = keys.join(other, "key").where("id <> near_id AND NOT (is_whole AND near_is_whole)").select("id", "near_id").distinct()
    both = pairs.join(words, "id").join(words.select(F.col("id").alias("near_id"), F.col("word").alias("near")), "near_id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")


# --- groups -----------------------------------------------------------------------------------------------------------

def follow(forms: DataFrame, folder: str) -> DataFrame:
    """word, root: each word's form, its form's form, and so on to the last. ``forms`` has word, root with its first form."""
    for step in range(64):
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = Observation()
        joined = forms.join(onward, "root", "left").observe(moved, F.count("further").alias("rows"))
        forms = stored(joined.select("word", F.coalesce("further", "root").alias("root")), f"{folder}/roots{step}")
        if not moved.get["rows"]:
            return forms
    raise ValueError("forms lead in a circle")


def variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word in ``words`` (columns word, distinct, and n)."""
    folder = work_folder(words.sparkSession, "spelling")
    sizes = Observation()
    size = F.char_length("word")
    short = size <= LONGEST
    words = words.select("word", "n")
    words = stored(words.observe(sizes, F.min(size).alias("least"), F.max(F.when(short, size)).alias("longest"),
                                 F.count_if(~short).alias("long")), f"{folder}/words")
    least, longest, long = (sizes.get.get(name) or 0 for name in ("least", "longest", "long"))
    near = trie_neighbours(words.where(short).select("word"), least, longest, folder)
    if long:
        near = near.unionByName(stored(long_neighbours(words.where(size >= LONGEST)), f"{folder}/long"))
    counted = near.distinct().join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The most frequent one first; of equal ones the first in the order of code points, which is that of UTF-8 bytes.
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                       F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form_n = -F.col("best.less")
    is_form = form_n >= dominance * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, form_n).alias("form_n"))
    rows = stored(rows, f"{folder}/forms")
    roots = follow(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), folder)
    return finished(rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), folder)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (columns doc_id and text)."""
    counts = corpus_words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return variants(counts.where(F.col("n") >= LEAST_COUNT))
