import time

import pytest

from helixframe.plans import scratch


class Session:
    """A session whose settings name no folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


class Cluster:
    class conf:
        @staticmethod
        def get(key, default=None):
            return "spark://host:7077" if key == "spark.master" else default


def test_the_session_names_the_folder(spark):
    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_own_folder_only_where_none_is_named():
    first = scratch.shared_dir(Session)
    assert first.startswith("file:///") and scratch.shared_dir(Session) == first


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)


def settle(spark):
    """Python's handles of the JVM's objects are let go of with a delay."""
    for _ in range(6):
        scratch.sweep(spark, force=True)
        time.sleep(0.3)


def test_tables_go_when_no_plan_reads_them(spark):
    scratch.drop_all()
    kept = scratch.cut(spark.range(7).toDF("a"), "kept").filter("a > 2")
    for i in range(5):
        scratch.cut(spark.range(i).toDF("a"), "gone").count()
    settle(spark)
    assert [("-kept-" in p) for p in scratch._made] == [True]
    assert kept.count() == 4
    del kept
    settle(spark)
    assert not scratch._made


def test_cut_reads_what_was_written(spark):
    df = scratch.cut(spark.range(5).toDF("a"), "t")
    assert sorted(r.a for r in df.collect()) == [0, 1, 2, 3, 4] and len(scratch._made) >= 1
    assert scratch.cut(df.filter("a > 9")).count() == 0
    scratch.drop_all()
    assert not scratch._made
