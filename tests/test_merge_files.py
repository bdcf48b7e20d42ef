"""A merge that writes only the files it changes."""

import pytest
from pyspark.sql import functions as F

from scriptmill.operators import merge_files as files
from scriptmill.operators.merge import When, merge_frames
from scriptmill.session import scratch_dir

def branches():
    return [
        When("delete", F.col("s.v") < 0),
        When("update", F.col("s.v") > 10, {"v": F.col("s.v")}),
        When("insert", F.col("s.v") > 0, {"id": F.col("s.id"), "v": F.col("s.v")}),
    ]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def target(spark):
    frame = spark.range(0, 1000, 1, 8).select("id", F.lit(0).alias("v"))
    return frame, files.create_files(frame, scratch_dir(spark))


def stamps(table):
    schema, names = table.files(table.version())
    return {n: table._files.getFileStatus(table._place(n)).getModificationTime() for n in names}


def test_only_touched_files_are_written(spark, target):
    frame, table = target
    before = stamps(table)
    assert len(before) == 8
    changes = [(5, 50), (6, -1), (7, 3), (300, 5), (1005, 9), (2000, -4), (None, 7)]
    source = spark.createDataFrame(changes, "id long, v int")
    got = files.merge_files(table, source, ["id"], branches())
    # 7 and 300 match, but no branch applies to them
    assert (got["version"], got["kept"], got["replaced"]) == (2, 7, 1)
    after = stamps(table)
    assert sum(after.get(n) == t for n, t in before.items()) == 7
    assert rows(table.read()) == rows(merge_frames(frame, source, ["id"], branches()))
    assert rows(table.read(1)) == rows(frame)


def test_nothing_to_do_makes_no_version(spark, target):
    frame, table = target
    for changes in ([], [(3, 1)]):
        got = files.merge_files(table, spark.createDataFrame(changes, "id long, v int"), ["id"], branches())
        assert got == {"version": 1, "kept": 8, "replaced": 0, "added": 0}
    assert rows(table.read()) == rows(frame)


def test_a_failed_merge_leaves_the_old_version(spark, target):
    frame, table = target
    with pytest.raises(Exception, match="several source rows"):
        files.merge_files(table, spark.createDataFrame([(5, 50), (5, 60), (900, 70)], "id long, v int"), ["id"], branches())
    assert table.version() == 1 and rows(table.read()) == rows(frame)


def test_the_second_of_two_commits_fails(spark, target):
    frame, table = target
    schema, names = table.files(1)
    table.commit(2, schema, names[:1])
    with pytest.raises(Exception, match="(?i)exist"):
        table.commit(2, schema, names[:2])
    assert table.files(2)[1] == names[:1]


def test_all_rows_deleted_and_merged_again(spark, target):
    frame, table = target
    files.merge_files(table, frame.select("id", F.lit(-1).alias("v")), ["id"], branches())
    assert table.read().count() == 0
    files.merge_files(table, spark.createDataFrame([(1, 20), (2, 30)], "id long, v int"), ["id"], branches())
    assert rows(table.read()) == [(1, 20), (2, 30)] and table.version() == 3
