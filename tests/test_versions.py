"""Stored versions of different schemas are read as one table, and flattened children equal the nested form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import joins as J
from tidemark.sources.versions import read_versions, write_version
from tidemark.streaming.feeds import scratch_path

NOW = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()),
                    T.StructField("flag", T.BooleanType()), T.StructField("at", T.TimestampNTZType()),
                    T.StructField("note", T.StringType()), T.StructField("extra", T.StringType())])


def stored(spark):
    root = scratch_path(spark, "versions")
    write_version(spark.createDataFrame([(1, 1.5), (None, None)], "id int, score float"), root, 1)
    write_version(spark.createDataFrame([(2, 7, None, dt.date(2024, 1, 2), "gone")],
                                        "id short, score int, flag boolean, at date, old string"), root, 2)
    write_version(spark.createDataFrame([(2**40, .25, True, dt.datetime(2024, 1, 3, 4), "n")],
                                        "id long, score double, flag boolean, at timestamp_ntz, note string"), root, 3)
    return root


def test_three_versions_are_one_scan_with_defaults(spark):
    root, day = stored(spark), dt.datetime(2023, 5, 6)
    got = read_versions(spark, root, [1, 2, 3], NOW, {"flag": F.lit(False), "at": F.lit(day).cast("timestamp_ntz"),
                                                      "note": F.lit("-")})
    assert got.schema.simpleString() == NOW.simpleString()
    assert {tuple(r) for r in got.collect()} == {
        (1, 1.5, False, day, "-", None), (None, None, False, day, "-", None),  # stored NULLs stay
        (2, 7.0, None, dt.datetime(2024, 1, 2), "-", None), (2**40, .25, True, dt.datetime(2024, 1, 3, 4), "n", None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert [r.id for r in read_versions(spark, root, [2], NOW).where("flag is null").collect()] == [2]


def test_types_that_do_not_widen_are_an_error(spark):
    root = stored(spark)
    write_version(spark.createDataFrame([("x",)], "id string"), root, 4)
    with pytest.raises(ValueError, match="version 4: id is string"):
        read_versions(spark, root, [1, 4], NOW)


def test_children_listed_flat(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (3, "c", 1), (4, None, 9), (5, "e", 2), (6, "", 6)],
                              "id long, task string, parent_task_id long")
    flat = {(r.id, r.child_pos, r.child_id, r.child_task) for r in J.subtask_list(t).collect()}
    nested = {(r.id, i + 1, c.id, c.task) for r in J.with_subtasks(t).collect() for i, c in enumerate(r.subtasks)}
    empty = {(r.id, None, None, None) for r in J.with_subtasks(t).collect() if not r.subtasks}
    assert flat == nested | empty and (1, 3, 3, "c") in flat and (4, None, None, None) in flat
