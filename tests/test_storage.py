"""Where staged files go."""

from types import SimpleNamespace

import pytest

from tonemark.sources import storage


def session(master, named=None):
    conf = SimpleNamespace(get=lambda key, default: named or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used():
    assert storage.shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert storage.new_path(session("local[2]", "/data/s"), "t").startswith("/data/s/t-")


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session("yarn"))


def test_local_mode_falls_back():
    assert storage.shared_dir(session("local[2]")).startswith("/tmp/spark-")


def test_the_session_setting_is_read(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    got = storage.shared_dir(spark)
    assert got == named if named else got.startswith("/tmp/spark-")
