"""Lineage cutting."""

from __future__ import annotations

import pytest

from tessera import session


def test_cuts_keep_rows_and_leave_no_plan(spark):
    df = spark.range(100).filter("id % 3 = 0")
    for cut in (session.cut, session.cut_table):
        got = cut(df)
        assert got.count() == df.count() == 34
        assert "Range" not in got._jdf.queryExecution().analyzed().toString()
    assert session.checkpoint_dir(spark) == session.checkpoint_dir(spark)


def test_written_tables_are_dropped(spark):
    session.cut_table(spark.range(3))
    path = session._tables[-1][1]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(fs_path)
    session.drop_tables()
    assert not fs.exists(fs_path) and not session._tables


def test_tables_that_are_done_with_go(spark):
    one, two = session.cut_table(spark.range(3)), session.cut_table(spark.range(4))
    session.drop_table(one)
    assert [at for _, at in session._tables] == [two._written] and two.count() == 4
    session.drop_tables()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    session_ = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda k, d: d)})})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(session_)
