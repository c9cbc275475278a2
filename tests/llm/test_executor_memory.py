"""What the pipeline's stages keep in executors and their Python workers."""

import os
import subprocess
import sys

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from loanloom.llm import common, exact_dedup, tokens


def state_threads(spark):
    """Names of the threads that open state stores hold."""
    threads = spark._jvm.java.lang.Thread.getAllStackTraces().keySet()
    return {name for t in threads if (name := t.getName()).startswith("ChecksumCheckpointFileManager")}


def test_no_state_store_stays_open(spark, tmp_path):
    docs = common.stored(spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)], "doc_id long, text string"),
                         f"{tmp_path}/documents")
    before = state_threads(spark)
    assert exact_dedup.drop_duplicates(docs).count() == 7
    assert state_threads(spark) <= before


def batch_sizes(docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    return [r.rows for r in docs.mapInArrow(sizes, "rows long").collect()]


@pytest.fixture
def unset(spark):
    before = spark.conf.get(common.ARROW_ROWS, None)
    spark.conf.unset(common.ARROW_ROWS)
    yield
    spark.conf.unset(common.ARROW_ROWS) if before is None else spark.conf.set(common.ARROW_ROWS, before)


@pytest.mark.parametrize("stage", [stage for name, stage in corpus_pipeline.STAGES if name != "exact_dedup"])
def test_texts_go_to_python_in_small_batches(spark, unset, tmp_path, stage):
    docs = common.stored(spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string"), f"{tmp_path}/docs")
    common.stored(spark.createDataFrame([(1, 1)], "doc_id long, quality int"), f"{tmp_path}/labels.parquet")
    stage(spark, docs, str(tmp_path))
    rows = spark.range(0, 2 * common.BATCH_ROWS + 1, 1, 1)
    assert batch_sizes(rows) == [common.BATCH_ROWS, common.BATCH_ROWS, 1]


def test_a_number_the_session_has_is_left(spark, unset):
    spark.conf.set(common.ARROW_ROWS, 5000)
    common.small_batches(spark)
    assert spark.conf.get(common.ARROW_ROWS) == "5000"


def test_stages_do_not_load_pandas():
    modules = "exact_dedup, near_dedup, packing, quality, secret_scan, token_files"
    code = f"import sys; from loanloom.llm import {modules}; sys.exit('pandas' in sys.modules)"
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def resident_mb():
    with open("/proc/self/smaps_rollup") as lines:
        return next(int(line.split()[1]) for line in lines if line.startswith("Anonymous:")) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_unused_memory_goes_back_after_the_last_slice():
    batches = common.slices([pa.RecordBatch.from_pydict({"text": ["a", "b"]})])
    next(batches)
    held = [np.ones(64 << 10, np.uint8) for _ in range(2000)]
    on_top = held[1::100]  # blocks that stay keep the C library from giving back what lies below
    del held
    before = resident_mb()
    assert list(batches) == [] and len(on_top) == 20
    assert resident_mb() < before - 60


@pytest.mark.parametrize("narrow", [tokens.NARROW, 5])
def test_remembered_units_take_few_bytes(monkeypatch, narrow):
    """Places among more ids than 32 bits can tell apart are held in 64."""
    monkeypatch.setattr(tokens, "NARROW", narrow)
    table = tokens.UnitTable()
    for begin in (0, 500):
        hashes = np.arange(begin, begin + 500, dtype=np.uint64)[::-1]
        table.add(hashes, np.repeat(hashes, 2) % 97, np.full(500, 2))
    places, known = table.find(np.array([998, 3, 1000], np.uint64))
    assert known.tolist() == [True, True, False]
    ids, lengths = table.ids(places[:2])
    assert ids.tolist() == [998 % 97] * 2 + [3] * 2 and lengths.tolist() == [2, 2] and lengths.dtype == np.int64
    assert sum(a.itemsize for a in (table.hashes, table.starts, table.lengths)) == (16 if narrow > 5 else 20)


def test_the_state_stores_cache_is_small(spark):
    session = exact_dedup._state_session(spark)
    assert int(session.conf.get("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB")) <= 64
