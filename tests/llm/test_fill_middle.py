"""Fill-in-the-middle against a version written on plain strings, and against DuckDB."""

import hashlib
import re

import duckdb
import pytest
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st

from loanloom.llm import fill_middle, queries


def plain_version(text, doc_id):
    """The contract on Python strings: n, form, prefix_chars, middle_chars, output."""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if doc_id is None:
        return n, "plain", None, None, text
    spelled = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(spelled[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def transformed(text, doc_id):
    done = fill_middle.transform_text(text.encode(), doc_id)
    return (*done[:4], fill_middle.text_of(done.pieces).decode())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<PSM>é \n€😀Z1"), max_size=30), st.integers(-5, 10 ** 12))
def test_each_text_as_the_contract_says(text, doc_id):
    expected = plain_version(text, doc_id)
    assert transformed(text, doc_id) == expected
    assert fill_middle.text_of(fill_middle.restore(expected[4].encode(), expected[1])).decode() == text


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_do_not_matter(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    for doc_id in range(60):
        text = "Grüße, an ALLE <x> — 12 und noch  mehr\tdavon" * (doc_id % 3)
        assert transformed(text, doc_id) == plain_version(text, doc_id)


def test_sentinels_that_parts_almost_spell():
    for prefix, suffix, middle in (("<S", "<M", ">"), ("a<", "S>", "<P"), ("", "", ""), ("<", "<<", "M>")):
        for form, output in (("psm", f"<P>{prefix}<S>{suffix}<M>{middle}"), ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}")):
            assert fill_middle.text_of(fill_middle.restore(output.encode(), form)).decode() == prefix + middle + suffix


ROWS = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "has <M> inside"), (None, "no id at all"),
        (5, "word " * 400_000), (6, "é" * 1000), (7, "x")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(t, i, "clash", 9) for i, t in ROWS], "text string, doc_id long, form string, n int")
    out = {(r.doc_id, r.output): tuple(r)[1:5] for r in fill_middle.transform(docs).collect()}
    assert out == {(i, plain_version(t or "", i)[4]): plain_version(t or "", i)[:4] for i, t in ROWS}
    assert sorted(fill_middle.restored(fill_middle.transform(docs)).toPandas().text) == sorted(t or "" for _, t in ROWS)
    assert fill_middle.transform(docs.limit(0)).count() == 0 == fill_middle.digests(docs.limit(0)).count()
    assert fill_middle.digests(docs).count() == len(ROWS)


def test_query_against_duckdb_and_its_own_outputs(spark):
    directory = f"{TESTDATA}/sf0.001"
    rows = queries.op11_fill_middle(spark, directory).toPandas().set_index("doc_id").sort_index()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{directory}/documents.parquet'")
    expected = con.execute(queries.ORACLE_SQL["op11_fill_middle"]).df().set_index("doc_id").sort_index()
    assert list(rows.columns) == list(expected.columns)
    assert rows.astype("string").fillna("-").equals(expected.astype("string").fillna("-")) or all(
        (rows[c].fillna(-1) == expected[c].fillna(-1)).all() for c in rows.columns)
    outputs = fill_middle.transform(queries.documents(spark, directory)).toPandas().set_index("doc_id").sort_index()
    assert [hashlib.sha256(o.encode()).hexdigest() for o in outputs.output] == list(rows.output_sha256)
    assert set(rows.form) == {"plain", "psm", "spm"}
