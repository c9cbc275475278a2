"""Fill-in-the-middle texts from a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its UTF-8 text and the
sentinels. Cutting splits the text's descriptor at two token boundaries, an arrangement permutes the parts and puts sentinel
descriptors between them, and a hash runs over the descriptors in their order. An output is read back in the same way: its
sentinels are found, the parts between them become descriptors over the output, and the inverse permutation restores the text.

Tokens are runs of ASCII letters and single other code points. A document's cuts and form follow from the SHA-256 of its
id, so that a repeated task gives the same output.

Defined results: a null text is empty, and an empty text is plain; so is a text that holds a sentinel, and every row
without a ``doc_id``, since its hash is missing; repeated rows give repeated results; rows do not depend on each other, so an
empty table gives an empty result; further columns are ignored. A text is scanned in blocks of ``BLOCK`` bytes, and beside
the text only its output is held, so a very long text needs about three times its own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed values of the output format.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ARRANGEMENTS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
ORDER = ("prefix", "middle", "suffix")
PLAIN_FROM, SPM_BELOW = 90, 20

BLOCK = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


# --- the piece table --------------------------------------------------------------------------------------------------

class Piece(NamedTuple):
    """``length`` bytes from ``start`` on of one of the buffers."""
    buffer: bytes
    start: int
    length: int

    def bytes(self) -> memoryview:
        return memoryview(self.buffer)[self.start:self.start + self.length]


def whole(buffer: bytes) -> Piece:
    return Piece(buffer, 0, len(buffer))


def cut(piece: Piece, at: list[int]) -> list[Piece]:
    """Split a descriptor at offsets within it, which do not fall."""
    bounds = [0, *at, piece.length]
    return [Piece(piece.buffer, piece.start + a, b - a) for a, b in zip(bounds, bounds[1:])]


def arrange(parts: dict[str, Piece], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its sentinel."""
    return [piece for name in ARRANGEMENTS[form] for piece in (whole(SENTINELS[name]), parts[name])]


def restore(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that spell the original text.

    No part holds a sentinel, and a sentinel cannot begin within a part and end behind it, so the first occurrence of each
    one, looked for in the order of the form, is its place.
    """
    if form == "plain":
        return [whole(output)]
    parts, end = {}, 0
    names = ARRANGEMENTS[form]
    for name, following in zip(names, [*names[1:], None]):
        start = end + len(SENTINELS[name])
        end = output.index(SENTINELS[following], start) if following else len(output)
        parts[name] = Piece(output, start, end - start)
    return [parts[name] for name in ORDER]


def text_of(pieces: list[Piece]) -> bytes:
    return b"".join(piece.bytes() for piece in pieces)


def digest(pieces: list[Piece]) -> str:
    """SHA-256 of what the descriptors spell, in hex."""
    running = hashlib.sha256()
    for piece in pieces:
        running.update(piece.bytes())
    return running.hexdigest()


# --- tokens -----------------------------------------------------------------------------------------------------------

def _token_starts(data: np.ndarray, begin: int) -> np.ndarray:
    """Which bytes of the block from ``begin`` on begin a token."""
    block = data[begin:begin + BLOCK]
    letters = _LETTER[block]
    starts = ~_CONTINUES[block]
    starts[1:] &= ~(letters[1:] & letters[:-1])
    if begin and letters[0] and _LETTER[data[begin - 1]]:
        starts[0] = False
    return starts


def count_tokens(data: np.ndarray) -> list[int]:
    """Tokens that begin in each block."""
    return [int(np.count_nonzero(_token_starts(data, begin))) for begin in range(0, len(data), BLOCK)]


def token_offset(data: np.ndarray, counts: list[int], number: int) -> int:
    """Where the first ``number`` tokens end, in bytes."""
    for block, count in enumerate(counts):
        if number < count:
            return block * BLOCK + int(np.flatnonzero(_token_starts(data, block * BLOCK))[number])
        number -= count
    return len(data)


def code_points(piece: Piece) -> int:
    data = np.frombuffer(piece.bytes(), np.uint8)
    return len(data) - sum(int(np.count_nonzero(_CONTINUES[data[i:i + BLOCK]])) for i in range(0, len(data), BLOCK))


def keys(doc_id: int) -> list[int]:
    """The four numbers that a document's cuts and form follow from."""
    spelled = hashlib.sha256(b"1:%d" % doc_id).hexdigest()
    return [int(spelled[i:i + 8], 16) for i in range(0, 32, 8)]


class Transformed(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[Piece]


def transform_text(text: bytes, doc_id: int | None) -> Transformed:
    """Cut one text and arrange its parts as its id says."""
    data = np.frombuffer(text, np.uint8)
    counts = count_tokens(data)
    n = sum(counts)
    own = None if doc_id is None else keys(doc_id)
    if own is None or not text or own[2] % 100 >= PLAIN_FROM or any(mark in text for mark in SENTINELS.values()):
        return Transformed(n, "plain", None, None, [whole(text)])
    first, second = sorted(key % (n + 1) for key in own[:2])
    form = "spm" if own[3] % 100 < SPM_BELOW else "psm"
    parts = dict(zip(ORDER, cut(whole(text), [token_offset(data, counts, first), token_offset(data, counts, second)])))
    return Transformed(n, form, code_points(parts["prefix"]), code_points(parts["middle"]), arrange(parts, form))


# --- tables -----------------------------------------------------------------------------------------------------------

_COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, Transformed]]:
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "").cast(pa.large_binary())
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
        yield doc_id, transform_text(text.as_py(), doc_id)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))


_LEADING = (["doc_id", "n", "form", "prefix_chars", "middle_chars"],
            [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs`` (columns doc_id and text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(doc_id, *done[:4], text_of(done.pieces)) for doc_id, done in _rows(batch)]
            made = _table(rows, [*_LEADING[0], "output"], [*_LEADING[1], pa.binary()])
            yield made.set_column(5, "output", made.column(5).cast(pa.string()))

    return _documents(docs).mapInArrow(run, f"{_COLUMNS}, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """doc_id, text of every row of ``outputs`` (columns doc_id, form and output): what ``transform`` was given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            spelled = [text_of(restore((output or "").encode(), form)).decode()
                       for output, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spelled, pa.string())], ["doc_id", "text"])

    return outputs.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """The columns of ``transform`` with the SHA-256 of each output, and of the text that is restored from it, in place of
    the output itself: outputs stay in the task that made them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(doc_id, *done[:4], digest(done.pieces), digest(restore(text_of(done.pieces), done.form)))
                    for doc_id, done in _rows(batch)]
            yield _table(rows, [*_LEADING[0], "output_sha256", "restored_sha256"],
                         [*_LEADING[1], pa.string(), pa.string()])

    return _documents(docs).mapInArrow(run, f"{_COLUMNS}, output_sha256 string, restored_sha256 string")
