"""Pipeline stages on an empty table, and on rows with null ids and texts, repeats and columns with clashing names."""

import corpus_pipeline
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from loanloom.llm import common

DIRECTORY = f"{TESTDATA}/sf0.001"
CLASHING = ("document", "file", "row", "digest", "dropped_id", "kept", "score", "component_id", "head", "node", "bucket", "key")
STAGES = corpus_pipeline.STAGES[:4]


@pytest.fixture(scope="module")
def good(spark):
    """Texts that the quality stage keeps."""
    rows = corpus_pipeline.good_documents(spark, spark.read.parquet(f"{DIRECTORY}/documents.parquet"), DIRECTORY)
    return [r.text for r in rows.where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").limit(6).collect()]


def through(spark, rows, folder):
    for name, stage in STAGES:
        made = common.stored(stage(spark, rows, DIRECTORY), f"{folder}/{name}")
        assert made.columns == rows.columns, name
        rows = made
    return rows


def test_null_ids_repeats_and_clashing_columns(spark, good, tmp_path):
    a, b, c, d, *_ = good
    docs = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, b), (4, c), (5, c + " and one more word"), (None, d)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({name: F.lit(name) for name in CLASHING})
    left = through(spark, common.stored(rows, f"{tmp_path}/in"), tmp_path)
    kept = sorted(((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()), key=str)
    assert [i for i, _ in kept] == [2, 3, 4, None]
    assert left.select(*CLASHING).distinct().collect() == [CLASHING]
    pieces = corpus_pipeline.packed_documents(spark, left, DIRECTORY)
    assert {r.doc_id for r in pieces.collect()} == {2, 3, 4, None}


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, text string, kept boolean, file string")
    left = through(spark, rows, tmp_path)
    assert left.count() == 0 == corpus_pipeline.packed_documents(spark, left, DIRECTORY).count()
