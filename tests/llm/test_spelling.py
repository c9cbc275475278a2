"""Spelling variants against a brute-force version."""

import collections
import itertools
import random
import re
import string
import zlib

from conftest import TESTDATA

from loanloom.llm import queries, spelling


def counted(docs):
    words = collections.Counter()
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                words[run] += 1
    return {word: n for word, n in words.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(words):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(sorted(words), 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b), near[b].append(a)
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda v: (-words[v], v), default=None)
        form[word] = best if best and words[best] >= 10 * n else None
    out = {}
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        out[word] = (form[word], root, n, len(near[word]), words[form[word]] if form[word] else None)
    return out


def result(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def test_all_neighbours_of_random_words(spark, monkeypatch):
    """Words on both sides of the tries' longest one."""
    monkeypatch.setattr(spelling, "LONGEST", 13)
    random.seed(3)
    words = {"abcdefg": 5000, "abcdefh": 400, "abcdefhh": 30, "abcdehhh": 2, "éabcdefg": 50, "bcdefgh": 50, "ÿÿÿÿÿÿÿ": 2}
    for size in (7, 8, 9, 12, 13, 14, 15, 40):
        base = "".join(random.choice("abé") for _ in range(size))
        for _ in range(25):
            i = random.randrange(size + 1)
            word = random.choice([base[:i] + base[i + 1:], base[:i] + random.choice("abé") + base[i:],
                                  base[:i] + "b" + base[i + 1:], base, base[1:], base + "a", "a" + base])
            if len(word) >= 7:
                words[word] = random.choice([2, 3, 20, 30, 300])
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = brute(words)
    assert result(spelling.variants(rows)) == expected
    assert any(v[0] and v[1] != v[0] for v in expected.values()) and any(len(w) > 14 and v[3] for w, v in expected.items())


def test_edge_rows(spark):
    long_word = "xyzé" * 4_000
    docs = [(1, None), (2, ""), (3, "12 34"), (4, "Château CHÂTEAU Chateaux chateaux"), (4, "Château CHÂTEAU Chateaux chateaux"),
            (None, "nowhere nowhere nowhere"), (5, f"{long_word} {long_word}"), (6, f"{long_word} q{long_word} q{long_word}"),
            (7, "nowhere " * 100_000), (8, "short short a a")]
    table = spark.createDataFrame([(t, i, 7, "x") for i, t in docs], "text string, doc_id long, n int, word string")
    words = counted(docs)
    assert result(spelling.spelling_variants(table)) == brute(words)
    assert long_word in words and "nowhere" in words
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_deletion_hashes_meet_where_words_are_near():
    for a, b in (("abcdefgh", "abcdxfgh"), ("abcdefgh", "abcdefghi"), ("abcdefgh", "xabcdefgh"), ("aaaa", "aaa")):
        assert set(spelling.deletion_hashes(a)) & set(spelling.deletion_hashes(b))
    assert not set(spelling.deletion_hashes("abcdefgh")) & set(spelling.deletion_hashes("abcdxygh"))


def test_query_against_brute_force(spark):
    directory = f"{TESTDATA}/sf0.001"
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, directory).collect()]
    assert result(queries.op13_spelling(spark, directory)) == brute(counted(docs))
