"""BPE through a table of distinct words, and back through a table of pieces.

1. Texts are split into units (words with the blank before them, see ``tokens``) in every input partition, and each
   partition's distinct units are dealt out by hash: one compressed list per partition and share.
2. The task of a share keeps a dictionary of the units it has met and encodes each distinct unit of the whole corpus
   once. It answers every list with the ids of its units.
3. Lists and answers go back to the partitions they came from, beside the texts, and the ids are put in place by the
   units' positions. A unit missing from the lists (a text changed between two readings) is encoded on the spot, so
   results never depend on the partitioning.

A join of all positions with the table would move every position as a row, several times the size of the texts; lists
of distinct units are a few percent of it. A unit that fills a third of all positions is one entry per partition.

Decoding joins ids with the vocabulary's pieces: a table of fixed size, held by every task.

Defined results: null text is empty; an empty text has no ids and decodes to an empty text; very long texts are whole;
repeated rows give repeated results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, range_hashes, slices, text_arrays
from .tokens import UnitTable, encode_units, encoder, load_tokenizer, ragged, unit_starts

_LISTS = "block int, share int, units binary"
# kind 0: an answer (units and their ids); kind 1: compressed texts in ``units``.
_PLACED = "block int, kind int, units binary, ids binary"
# Texts move in compressed packs of about so many bytes.
PACK_BYTES = 4 << 20


# --- lists of units ---------------------------------------------------------------------------------------------------

def pack_units(units: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, units), "<u4", len(units))
    return zstandard.compress(np.uint32(len(units)).tobytes() + lengths.tobytes() + b"".join(units), 3)


def unpack_units(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the units."""
    raw = zstandard.decompress(blob)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", count, 4).astype(np.int64))
    data = np.frombuffer(raw, np.uint8, offset=4 + 4 * count)
    return data, np.append(0, ends[:-1])[:count], ends


def pack_ids(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    return zstandard.compress(np.uint32(len(lengths)).tobytes() + lengths.astype("<u4").tobytes()
                              + ids.astype("<u2").tobytes(), 3)


def unpack_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    return (np.frombuffer(raw, "<u2", offset=4 + 4 * count),
            np.frombuffer(raw, "<u4", count, 4).astype(np.int64))


def _unit_lists(shares: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct units of this partition, by share."""
        seen = np.zeros(0, np.uint64)
        found: list[bytes] = []
        found_hashes: list[np.ndarray] = []
        block = None
        for batch in slices(batches):
            block = batch.column("block")[0].as_py()
            data, offsets = text_arrays(batch.column("text"))
            starts = unit_starts(data, offsets)
            ends = np.append(starts[1:], len(data))
            hashes, first = np.unique(range_hashes(data, starts, ends), return_index=True)
            at = np.searchsorted(seen, hashes)
            new = np.ones(len(hashes), bool)
            inside = at < len(seen)
            new[inside] = seen[at[inside]] != hashes[inside]
            raw = data.tobytes()
            found += [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            found_hashes.append(hashes[new])
            seen = np.insert(seen, at[new], hashes[new])
        if block is None or not found:
            return
        share = (np.concatenate(found_hashes) % np.uint64(shares)).astype(int)
        order = np.argsort(share, kind="stable")
        bounds = np.searchsorted(share[order], np.arange(shares + 1))
        for k in range(shares):
            units = sorted(found[i] for i in order[bounds[k]:bounds[k + 1]].tolist())
            if units:
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int32()), "share": pa.array([k], pa.int32()),
                    "units": pa.array([pack_units(units)], pa.binary())})
    return lists


def _encode_lists(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answer each list with its units' ids; each distinct unit of the shares in this task is encoded once."""
        tokenizer = load_tokenizer(path)
        table = UnitTable()
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("units").to_pylist()):
                data, starts, ends = unpack_units(blob)
                hashes = range_hashes(data, starts, ends)
                _, known = table.find(hashes)
                if not known.all():
                    raw = data.tobytes()
                    new = np.flatnonzero(~known)
                    units = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
                    table.add(hashes[new], *encode_units(tokenizer, units))
                places, _ = table.find(hashes)
                ids, lengths = table.ids(places)
                yield _placed(block, 0, blob, pack_ids(ids, lengths))
    return encode


def _placed(block: int, kind: int, units: bytes, ids: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int32()), "kind": pa.array([kind], pa.int32()),
        "units": pa.array([units], pa.binary()), "ids": pa.array([ids], pa.binary())})


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as compressed packs: less to move than rows."""
    for batch in slices(batches, limit=PACK_BYTES):
        rows = batch.select(["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows)
        yield _placed(batch.column("block")[0].as_py(), 1, sink.getvalue().to_pybytes(), None)


def _place(path: str, result: Callable, fields: list[tuple[str, pa.DataType]]):
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a block the answers come first, then the texts."""
        own = encoder(path)
        own.table, block = UnitTable(), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    own.table, block = UnitTable(), row["block"]
                if row["kind"] == 0:
                    _remember(own.table, row["units"], row["ids"])
                    continue
                with pa.ipc.open_stream(row["units"]) as packed:
                    for rows in slices(packed):
                        ids, offsets = own.encode(rows.column("text"))
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("doc_id"), *result(ids, offsets)], schema=schema)
    return place


def _remember(table: UnitTable, units: bytes, ids: bytes) -> None:
    data, starts, ends = unpack_units(units)
    table.add(range_hashes(data, starts, ends), *unpack_ids(ids))


def encode_documents(docs: DataFrame, path: str, result: Callable, fields: list[tuple[str, pa.DataType]], ddl: str,
                     shares: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) with the vocabulary at ``path``; ``result`` makes the columns ``fields``
    (``ddl`` in Spark's terms) of a slice's ids and offsets. ``shares``: how many tasks hold the table of units."""
    spark = docs.sparkSession
    shares = shares or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    lists = docs.select(F.spark_partition_id().alias("block"), "text").mapInArrow(_unit_lists(shares), _LISTS)
    answers = lists.repartition(shares, "share").mapInArrow(_encode_lists(path), _PLACED)
    texts = docs.select(F.spark_partition_id().alias("block"), "doc_id", "text").mapInArrow(_pack_texts, _PLACED)
    together = answers.unionByName(texts).repartition(shares, "block").sortWithinPartitions("block", "kind")
    return together.mapInArrow(_place(path, result, fields), f"doc_id long, {ddl}")


def ids_column(ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))]


def encode(docs: DataFrame, path: str, shares: int | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every document."""
    return encode_documents(docs, path, ids_column, [("ids", pa.list_(pa.int32()))], "ids array<int>", shares)


# --- decoding ---------------------------------------------------------------------------------------------------------

class Pieces:
    """The vocabulary's pieces as bytes, one after the other, by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        special = {x["content"]: x["id"] for x in content["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(hidden)}
        pieces = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for piece, i in vocabulary.items():
            pieces[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        for piece, i in special.items():
            pieces[i] = piece.encode()
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        lengths = self.lengths[ids]
        data = self.data[ragged(self.starts[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids (byte-level vocabularies)."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            column = batch.column("ids")
            offsets = np.append(0, np.cumsum(pd.Series(column.value_lengths().to_numpy(zero_copy_only=False)).fillna(0)))
            ids = column.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                              "text": pa.array(table.decode(ids, offsets.astype(np.int64)), pa.string())})
    return own_columns(encoded, "doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def digests(docs: DataFrame, path: str, shares: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and the text decoded from them, as digests."""
    def columns(ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        raw = memoryview(ids.astype("<u4")).cast("B") if len(ids) else b""
        bounds = (offsets * 4).tolist()
        return [pa.array(np.diff(offsets)),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in pieces(path).decode(ids, offsets)],
                         pa.string())]
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return encode_documents(docs, path, columns, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", shares)
