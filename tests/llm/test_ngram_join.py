"""The n-gram join, its orders, and components, against brute force."""

import random

import numpy as np
import pyarrow as pa

from loanloom.llm import links, near_dedup, ngram_join


def set_of(text, words=5):
    found = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not found:
        return frozenset()
    return frozenset(" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def components_of(docs, threshold):
    """doc_id -> smallest doc_id reachable, from all pairs."""
    sets = [(i, set_of(t)) for i, t in docs if i is not None]
    least = {i: i for i, _ in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((root(i), root(j)))
                least[y] = x
    return {i: root(i) for i in least}


def sorted_rows(rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows.collect()), key=str)


def expected_rows(docs, threshold=80):
    component = components_of(docs, threshold)
    return sorted(((i, len(set_of(t)), component.get(i)) for i, t in docs), key=str)


def near_copies(seed, count, groups):
    """Texts made of a base per group, with a few words changed, so that similarities lie on both sides of the threshold."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice((30, 80, 200)))] for _ in range(groups)]
    docs = []
    for i in range(count):
        text = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 1, 1, 2, 3, 5))):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        if rnd.random() < 0.2:
            text += [rnd.choice(words) for _ in range(rnd.randrange(12))]
        docs.append((10_000 - i * 3, " ".join(text)))
    return docs


def test_links_against_all_pairs(spark):
    docs = near_copies(1, 300, 12)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    expected = expected_rows(docs)
    assert 12 < len({c for _, _, c in expected}) < 200
    assert sorted_rows(ngram_join.similar_documents(table)) == expected
    # All buckets large: leaders and chunks alone find the same.
    assert sorted_rows(ngram_join.similar_documents(table, small=1)) == expected


def test_a_lower_threshold(spark):
    docs = near_copies(2, 120, 5)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted_rows(ngram_join.similar_documents(table, threshold=50)) == expected_rows(docs, 50)


def test_edge_rows(spark):
    long_text = " ".join(f"z{i}" for i in range(100_000))
    docs = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long_text),
            (8, long_text + " end"), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (9, "quite another text of some words here"),
            (10, "quite another text of some words here"), (None, "one two"), (11, "é é é é é é"), (12, "")]
    table = spark.createDataFrame([(t, i, 3, "x", 1) for i, t in docs], "text string, doc_id long, n_shingles int, digest string, bucket int")
    rows = {(i, n): c for i, n, c in sorted_rows(ngram_join.similar_documents(table))}
    assert len(ngram_join.similar_documents(table).collect()) == len(docs)
    assert rows == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (6, 1): 6, (7, 99_996): 7, (8, 99_997): 7, (9, 4): 9,
                    (9, 3): 9, (10, 3): 9, (None, 1): None, (11, 1): 11, (12, 0): 12}
    assert ngram_join.similar_documents(table.limit(0)).count() == 0


def test_linked_sets_share_a_prefix_shingle_under_every_order():
    rng = np.random.default_rng(8)
    table = rng.integers(0, 8, 1 << ngram_join.TABLE_BITS).astype(np.uint8)
    for size in (1, 2, 5, 24, 100):
        for _ in range(40):
            whole = np.unique(rng.integers(1 << 63, size=size, dtype=np.uint64) * np.uint64(2))
            other = np.union1d(whole[rng.random(len(whole)) < 0.93], rng.integers(1 << 63, size=size // 12, dtype=np.uint64))
            shared = len(np.intersect1d(whole, other))
            if 100 * shared >= 80 * (len(whole) + len(other) - shared) > 0:
                for a, b in zip(ngram_join.prefixes(whole, table, 80), ngram_join.prefixes(other, table, 80)):
                    assert len(np.intersect1d(a, b))


def test_common_shingles_come_last(spark):
    counted = spark.createDataFrame([(-5, 2), (-5, 7), (1 << 50, 100_000)], "token long, times long")
    table = ngram_join.class_table(counted)
    tokens = np.array([-5, 1 << 50], np.int64).view(np.uint64)
    assert table[ngram_join._cells(tokens)].tolist() == [2, len(ngram_join.COMMON_FROM)]
    assert np.count_nonzero(table) == 2
    shingles = np.sort(np.append(tokens, np.arange(8, dtype=np.uint64) << np.uint64(56)))
    for first in ngram_join.prefixes(shingles, table, 60):
        assert not np.isin(tokens, first).any()


def test_components_of_random_graphs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    for k, (nodes, edges) in enumerate(((50, 30), (400, 380), (400, 900))):
        a, b = rng.integers(nodes, size=(2, edges)) - 7
        # A path whose ids fall and rise, and a star about the largest id.
        path = np.append(np.arange(2000, 2040)[::-1], np.arange(2041, 2060))
        a, b = np.concatenate([a, path[:-1], np.arange(3000, 3100)]), np.concatenate([b, path[1:], np.full(100, 9999)])
        ids, least = links.least_connected(a, b)
        table = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").repartition(4)
        with monkeypatch.context() as m:
            m.setattr(links, "WINDOW", 16)
            found = {r.doc_id: r.component_id for r in links.components(table, f"{tmp_path}/{k}").collect()}
        assert found == {int(i): int(c) for i, c in zip(ids, least) if i != c}


def test_chunks_connect_what_is_linked(spark):
    docs = near_copies(5, 60, 2)
    sets = [s.view(np.int64) for s in near_dedup.shingle_sets(pa.array([t for _, t in docs]))]
    table = pa.table({"doc_id": [i for i, _ in docs], "label": [i for i, _ in docs], "shingles": [s.tolist() for s in sets]})
    found = links.compare_chunks(table, 80)
    ids, least = links.least_connected(found.column("a").to_numpy(), found.column("b").to_numpy())
    expected = components_of(docs, 80)
    assert dict(zip(ids.tolist(), least.tolist())) == {i: c for i, c in expected.items()
                                                       if list(expected.values()).count(c) > 1}
    assert found.num_rows < len(docs)
