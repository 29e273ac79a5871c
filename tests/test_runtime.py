from types import SimpleNamespace as N

import pytest

from hitloom import runtime as R


def session(master, conf=(), checkpoint=None):
    values = dict(conf)
    option = N(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    sc = N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: option)))
    return N(sparkContext=sc, conf=N(get=lambda k, d=None: values.get(k, d), set=values.__setitem__))


def test_shared_folder_is_the_named_one():
    assert R.shared_dir(session("spark://x:1", {"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    assert R.shared_dir(session("yarn", checkpoint="hdfs://a/c")) == "hdfs://a/c"


def test_a_cluster_without_one_is_an_error_and_a_machine_gets_its_own():
    for master in ("yarn", "spark://x:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            R.shared_dir(session(master))
    s = session("local[4]")
    first = R.shared_dir(s)
    assert first.startswith("file://") and R.shared_dir(s) == first


def test_dropped_tables_leave_no_files(spark):
    import os

    t = R.materialise(spark.range(10).toDF("id"), "probe")
    folder = os.path.dirname(t.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder) and t.count() == 10
    R.drop_table(t)
    assert not os.path.exists(folder)
