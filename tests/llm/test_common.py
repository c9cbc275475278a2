"""Work folders: where they lie, and what is left in them."""

import os
from types import SimpleNamespace

import pytest

from loanloom.llm import common, near_dedup


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir is not set"):
        common.work_folder(session(master), "x")
    named = common.work_folder(session(master, **{"spark.checkpoint.dir": "hdfs:///shared/"}), "x")
    assert named.startswith("hdfs:///shared/loanloom-x-")


def test_one_process_has_a_folder_of_its_own():
    one, other = (common.work_folder(session("local[4]"), "x") for _ in range(2))
    assert one != other and os.path.dirname(one) == os.path.dirname(other) and one.startswith("file:///")


def test_only_the_result_stays(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/work"
    common.stored(spark.range(5), f"{folder}/step")
    rows = common.finished(spark.read.parquet(f"{folder}/step").where("id > 2"), folder)
    assert os.listdir(folder) == ["result"] and rows.count() == 2
    monkeypatch.setattr(near_dedup, "work_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    docs = spark.createDataFrame([(i, "one two three four five six " + "seven " * (i % 2)) for i in range(6)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 6 and os.listdir(f"{tmp_path}/near") == ["result"]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {file for file in files.split("\n") if "/shuffle_" in file}


def test_stored_rows_leave_no_shuffle_files(spark, tmp_path):
    before, setting = _shuffle_files(spark), spark.conf.get(common.SHUFFLE_CLEANUP)
    rows = common.stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), f"{tmp_path}/rows")
    assert rows.agg({"count": "sum"}).first()[0] == 1000 and spark.conf.get(common.SHUFFLE_CLEANUP) == setting
    common.stored(rows.groupBy("count").agg({"k": "max"}), f"{tmp_path}/more")
    left = {file.rpartition("/")[2].split("_")[1] for file in _shuffle_files(spark) - before}
    assert len(left) <= 1, left  # that of the sum, which was not stored
