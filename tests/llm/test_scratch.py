import os

import pytest

from shapeloom.llm import scratch


def test_tables_lie_in_the_shared_folder_and_go(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_held", {})
    df = scratch.table(spark.range(5).selectExpr("id", "id % 2 = 0 AS even"), "t")
    path = df.inputFiles()[0]
    assert path.startswith(scratch.root(spark)) and sorted(map(tuple, df.collect())) == [(k, k % 2 == 0) for k in range(5)]
    scratch.release()
    assert not os.path.exists(path.removeprefix("file://"))
    scratch.release()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(Session())


def test_empty_tables_keep_their_schema(spark):
    df = scratch.table(spark.range(0).selectExpr("id", "array(id) AS a"), "t")
    assert df.count() == 0 and df.columns == ["id", "a"]
