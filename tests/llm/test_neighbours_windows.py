"""Windows are counted by ranks: the same candidates as by definition, in a fraction of the time of fetching their members."""

import time

import numpy as np
import pytest

from loanloom.llm import neighbours


def by_definition(ids, vectors, index, query_id, query, enough):
    """Candidates by the distances of all projections, over the row of widths from its beginning."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    own = query / np.sqrt((query * query).sum()) @ index.directions + index.lift
    apart = (unit @ index.directions).T + index.lift[:, None]
    other, width = ids != query_id, neighbours.FIRST_WIDTH
    enough = min(max(enough, int(neighbours.ENOUGH_SHARE * len(set(ids.tolist())))), len(set(ids[other].tolist())))
    while True:
        inside = (apart >= (own - width)[:, None]) & (apart <= (own + width)[:, None])
        found = np.flatnonzero((inside.sum(axis=0) >= neighbours.COLLISIONS * len(own)) & other)
        if inside.all() or len(set(ids[found].tolist())) >= enough:
            return found
        width *= neighbours.GROWTH


# Around the sizes at which ranks need a wider type; more projections than a byte counts; ids once and many times.
@pytest.mark.parametrize("size, projections, repeat", [(1, 96, 1), (2, 96, 1), (254, 96, 1), (255, 96, 3), (256, 96, 1), (257, 300, 2),
                                                       (700, 96, 1), (700, 7, 100)])
def test_candidates_are_those_of_the_first_width(size, projections, repeat):
    rng = np.random.default_rng(size + projections)
    vectors = rng.normal(size=(size, 8))
    vectors[size // 2:size // 2 + 20] = vectors[0]
    ids = np.arange(size) // repeat
    index = neighbours.BlockIndex(ids, vectors, projections)
    # From near to far and back: each search begins at the step at which the one before ended.
    for query in [vectors[0], -vectors[0], *rng.normal(size=(5, 8)), vectors[-1], np.full(8, 1.0), vectors[0]]:
        for query_id, enough in ((0, 5), (int(ids[-1]), 120), (-1, 20)):
            found = index.candidates(query_id, query, enough)
            assert found.tolist() == by_definition(ids, vectors, index, query_id, query, enough).tolist()


def test_best_of_a_block_with_ties():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 16))
    vectors[100:130] = vectors[7]
    ids = rng.permutation(500)
    index = neighbours.BlockIndex(ids, vectors)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    at = index.candidates(int(ids[7]), vectors[7])
    scores = neighbours.cosines(vectors[at], norms[at], vectors[7], norms[7])
    best = sorted(zip(-scores, ids[at].tolist()))[:5]
    assert index.search(int(ids[7]), vectors[7], 5) == [(i, -s) for s, i in best]
    assert [i for _, i in best] == sorted(ids[100:130].tolist())[:5]


def test_a_query_takes_less_than_fetching_its_collisions_twice():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(8192, 64))
    index = neighbours.BlockIndex(np.arange(8192), vectors)
    order = np.argsort(rng.normal(size=(neighbours.PROJECTIONS, 8192)), axis=1).ravel()
    # A window holds some 45 % of such a block.
    places = np.concatenate([np.arange(3700) + 8192 * j for j in range(neighbours.PROJECTIONS)])

    def seconds(run) -> float:
        times = []
        for i in range(30):
            begin = time.process_time()
            run(i)
            times.append(time.process_time() - begin)
        return float(np.median(times))

    one_by_one = seconds(lambda i: np.bincount(order[places], minlength=8192))
    assert seconds(lambda i: index.candidates(i, vectors[i])) < 2 * one_by_one
