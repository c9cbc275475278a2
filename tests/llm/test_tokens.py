import random

import numpy as np
import pyarrow as pa
import pytest

from loanloom.llm.queries import BYTE_BPE, WORD_BPE
from loanloom.llm.tokens import RUN, Encoder, encode_units, load_tokenizer, unit_starts

SIGNS = ["a", "É", "ß", "×", "÷", "Σ", "İ", "'", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", " ", "　", "́", "̸", "=",
         "<", "<|", ",", ".", "-", "_", "23", "½", "漢", "😀", "\x1c", "\x85", "The", "é", "\r\n"]


def units_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return [part.tobytes().decode() for part in np.split(data, unit_starts(data, np.array([0, len(data)]))[1:])]


def test_a_word_is_one_unit_whatever_sign_follows():
    assert units_of("the oak, the oak. the oak\nthe") == ["the", " oak", ",", " the", " oak", ".", " the", " oak", "\nthe"]
    assert units_of("the oak's é, ÷, 3,") == ["the", " oak's", " é", ",", " ÷,", " 3,"]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_units_are_encoded_in_few_texts(path):
    """Each as the library encodes it by itself, in the order given."""
    tokenizer, texts = load_tokenizer(path), []

    class Counting:
        def encode_batch(self, given, **options):
            texts.extend(given)
            return tokenizer.encode_batch(given, **options)

        encode_batch_fast = encode_batch

    units = [u for i in range(2 * RUN) for u in (f" wörd{i}", f" x{i},\n", *([","] if i == 7 else []), *([" "] if i == 9 else []))]
    ids, lengths = encode_units(Counting(), units)
    assert len(texts) < 10
    single = [e.ids for e in tokenizer.encode_batch(units, add_special_tokens=False)]
    assert lengths.tolist() == [len(x) for x in single] and ids.tolist() == [i for x in single for i in x]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_ids_of_odd_texts(path):
    draw = random.Random(7)
    texts = ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    ids, offsets = Encoder(path).encode(pa.array(texts))
    for i, expected in enumerate(load_tokenizer(path).encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == expected.ids, texts[i]
    assert len(Encoder(path).encode(pa.array([None, ""], pa.string()))[0]) == 0
