"""Short pieces in bundles: room for all, and little padding."""

import numpy as np
import pytest

from loanloom.llm import packing


def packed(lengths, capacity=packing.CAPACITY):
    kind = np.minimum(packing.length_classes(np.asarray(lengths)), capacity)
    rank = np.zeros(len(kind), np.int64)
    for k in np.unique(kind):
        rank[kind == k] = np.arange((kind == k).sum())
    layout = packing.Layout({int(k): int((kind == k).sum()) for k in np.unique(kind)}, capacity)
    return layout.sequences(kind, rank)


@pytest.mark.parametrize("size, most", [(1, 5), (3, 16), (17, 86), (63, 320), (65, 380), (130, 670), (2048, 10_000)])
def test_equal_pieces_fill_sequences(size, most):
    sequence = packed(np.full(10_000, size))
    assert np.bincount(sequence).max() * size <= packing.CAPACITY and len(np.unique(sequence)) <= most


@pytest.mark.parametrize("seed", range(4))
def test_all_lengths_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 80, 3000), rng.integers(1, 2049, 400), np.full(seed * 5, 256), [1]])
    rng.shuffle(lengths)
    sequence = packed(lengths)
    filled = np.bincount(sequence, weights=lengths)
    assert filled.max() <= packing.CAPACITY and (filled > 0).all()
    assert lengths.sum() / (len(filled) * packing.CAPACITY) > 0.95


def test_classes_hold_their_lengths():
    lengths = np.arange(1, packing.CAPACITY + 1)
    kind = packing.length_classes(lengths)
    assert (kind >= lengths).all() and (kind - lengths < 16).all() and kind.max() == packing.CAPACITY
    assert (kind[:64] == lengths[:64]).all() and len(np.unique(kind)) < 250
    assert packed(np.array([5])).tolist() == [0]
