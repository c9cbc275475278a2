"""Token ids of whole texts, as the tokenizers library gives them, with each distinct unit encoded once per process.

Texts are cut before every blank that a character other than white space follows, and where a Latin letter meets an ASCII
sign other than an apostrophe, or a line end. Both vocabularies' pre-tokenisers treat the two sides of such a cut alike
whether together or apart, so the ids of a text are those of its units, one after the other. Units are found and hashed
as arrays; only units not met before go to the tokenizer, those that begin at a blank many in one text. A text that holds the
beginning of a special token's string is encoded as a whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import range_hashes, text_arrays

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Bytes after a blank at which a text is not cut: ASCII white space and separators, and first bytes of other white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True

# Letters of one byte, and what a text is cut before where it follows a letter: runs of letters end there in both vocabularies.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_AFTER_LETTER = np.zeros(256, bool)
_AFTER_LETTER[[*b"\n!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True

# Units that are encoded as one text.
RUN = 512
# Units remembered by one process; beyond that it starts anew.
REMEMBERED = 1_500_000
# Ids up to which places among them are held in 32 bits.
NARROW = 1 << 32


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at the beginning of each text that is not empty, and at the cuts described above."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(data), bool)
    cut[:-1] = (data[:-1] == 0x20) & ~_NO_CUT[data[1:]]
    letter = _LETTER[data]
    # U+00C0 to U+00FF without the two signs among them.
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:] |= letter[:-1] & _AFTER_LETTER[data[1:]]
    ends = offsets[1:]
    ends = ends[ends > 0]
    cut[ends - 1] = False  # a blank that ends its text
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class UnitTable:
    """Ids of units by hash: three sorted arrays and one pool of ids."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.uint32)
        self.pool = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        places = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return places, np.zeros(len(hashes), bool)
        places = np.minimum(places, len(self.hashes) - 1)
        return places, self.hashes[places] == hashes

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at ``places`` one after the other, and how many each has."""
        lengths = self.lengths[places].astype(np.int64)
        return self.pool[ragged(self.starts[places].astype(np.int64), lengths)], lengths

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add distinct new hashes with their ids, which lie one after the other."""
        while self.used + len(ids) > len(self.pool):
            larger = np.zeros(2 * len(self.pool), np.uint16)
            larger[:self.used] = self.pool[:self.used]
            self.pool = larger
        self.pool[self.used:self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        if self.used > NARROW:
            self.starts = self.starts.astype(np.int64)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.starts = np.insert(self.starts, at, starts[order])
        self.lengths = np.insert(self.lengths, at, lengths[order])


def _encode_texts(tokenizer, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units of texts that consist of units, and how many each unit has."""
    ids, lengths = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for units, found in zip(texts, tokenizer.encode_batch(["".join(units) for units in texts], add_special_tokens=False)):
        own = found.ids
        ids.append(np.array(own, np.uint16))
        if len(units) == 1:
            lengths.append(np.array([len(own)], np.int64))
            continue
        begins = np.cumsum([0, *map(len, units[:-1])])
        at = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(own))[::2]
        lengths.append(np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(units)))
    return np.concatenate(ids), np.concatenate(lengths)


def encode_units(tokenizer, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units one after the other, and how many each has.

    A text may be cut before a blank that no white space follows, so units that begin like that are put together to longer
    texts, and the places of the ids tell whose they are.
    """
    joined = np.fromiter((len(u) > 1 and u[0] == " " and not _NO_CUT[u[1].encode()[0]] for u in units), bool, len(units))
    order = np.argsort(joined, kind="stable")
    alone = len(units) - int(joined.sum())
    placed = [units[i] for i in order.tolist()]
    ids, lengths = _encode_texts(tokenizer, [[u] for u in placed[:alone]] + [
        placed[i:i + RUN] for i in range(alone, len(placed), RUN)])
    starts = np.cumsum(lengths) - lengths
    back = np.argsort(order)
    return ids[ragged(starts[back], lengths[back])], lengths[back]


class Encoder:
    """Encodes the texts of Arrow columns; one per process and vocabulary."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = load_tokenizer(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit into 16 bits")
        self.remembered = remembered
        self.table = UnitTable()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (16 bits each), and where those of each text begin, with the end."""
        data, offsets = text_arrays(texts)
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = range_hashes(data, starts, ends)
        # Not by pandas, which would take some 25 MB of every Python worker.
        found = pa.array(hashes).dictionary_encode()
        codes, distinct = found.indices.to_numpy(), found.dictionary.to_numpy()
        places, known = self.table.find(distinct)
        if not known.all():
            if len(self.table.hashes) > self.remembered:
                self.table, known = UnitTable(), np.zeros(len(distinct), bool)
            first = np.full(len(distinct), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = data.tobytes()
            new = first[~known]
            units = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            self.table.add(distinct[~known], *encode_units(self.tokenizer, units))
            places, known = self.table.find(distinct)
        ids, lengths = self.table.ids(places[codes])
        before = np.append(0, np.cumsum(lengths))
        offsets_of_ids = before[np.searchsorted(starts, offsets)]
        return self._with_specials(texts, data, offsets, ids, offsets_of_ids)

    def _with_specials(self, texts, data, offsets, ids, id_offsets):
        at = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) > 1 else ()
        if not len(at):
            return ids, id_offsets
        own = set((np.searchsorted(offsets, at, "right") - 1).tolist())
        parts = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint16)
                 if i in own else ids[id_offsets[i]:id_offsets[i + 1]] for i in range(len(texts))]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.append(0, np.cumsum(lengths))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
