"""Deliveries of the change streams: no step per task in Python, restarts, changes without a time, buckets left alone."""

import json
import os

from pyspark.sql import functions as F

from tests.test_stateful import event_files, small_batches  # noqa: F401
from tidemark.streaming import feeds as FD
from tidemark.streaming.buckets import BucketStore

TASKS = "id long, user_id string, task string"


def local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_last_rows_are_kept_in_buckets_and_found_after_a_restart(spark):
    root, folder = FD.scratch_path(spark, "subs"), FD.scratch_path(spark, "late")
    files = event_files(spark, [[(0, 0, 1, "signup"), (1, 5, 2, "click")], [(2, 9, 3, "error"), (40, 9, 1, "click")]])
    tasks = spark.createDataFrame([(i, "u9", f"t{i}") for i in range(2, 200)], TASKS)
    os.makedirs(local(folder))
    os.link(f"{local(files)}/events-0.parquet", f"{local(folder)}/events-0.parquet")
    first = FD.subscription_stream(spark, folder, tasks, root, per_task=4)
    assert {(r.subscriber, r.event_id) for r in first.collect()} == {("u1", 0), ("u2", 1), ("u1", 1)}
    os.link(f"{local(files)}/events-1.parquet", f"{local(folder)}/events-1.parquet")
    # the start table is not read again
    got = FD.subscription_stream(spark, folder, tasks.limit(0), root, per_task=4)
    assert {(r.subscriber, r.event_id) for r in got.collect()} == {
        ("u1", 0), ("u2", 1), ("u1", 1), ("u2", 2), ("u1", 40), ("u9", 40)}
    store = BucketStore(spark, root, {"rows": "task_id"})
    now = {(r.task_id, r.user_id, r.task) for r in store.read("rows", "task_id long, user_id string, task string").collect()}
    assert now == {(i, "u9", f"t{i}") for i in range(2, 200) if i != 11} | {(11, "u1", "t11")}
    touched = store.of(spark.createDataFrame([(1,), (11,)], "id long"), "id")
    written = {int(x.split("=")[1]) for x in os.listdir(f"{local(root)}/v2/rows") if x.startswith("bucket=")}
    assert written <= set(touched) and len(touched) <= 2


def test_changes_without_a_time_come_last(spark, small_batches):  # noqa: F811
    """One task's changes in many Arrow batches, some without a time: each is delivered once."""
    files = event_files(spark, [[(e, e if e < 60 else 0, e % 7, "click") for e in range(70)]])
    ev = spark.read.schema(FD.EVENT_SCHEMA).parquet(files).withColumn("ts", F.when(F.col("event_id") < 60, F.col("ts")))
    folder = FD.scratch_path(spark, "no-time")
    ev.coalesce(1).write.parquet(f"{folder}/tmp")
    source = next(f for f in os.listdir(f"{local(folder)}/tmp") if f.endswith(".parquet"))
    os.link(f"{local(folder)}/tmp/{source}", f"{local(folder)}/events.parquet")
    got = FD.subscription_stream(spark, folder, spark.createDataFrame([(1, "u9", "x")], TASKS),
                                 FD.scratch_path(spark, "subs"), per_task=100).collect()
    want = {(f"u{e % 7}", e) for e in range(70)} | {(f"u{(e - 1) % 7}" if e else "u9", e) for e in range(70)}
    assert {(r.subscriber, r.event_id) for r in got} == want and len(got) == len(want)


def test_no_events_give_no_rows(spark):
    files = event_files(spark, [[(0, 0, 1, "click")]])
    ev = spark.read.schema(FD.EVENT_SCHEMA).parquet(files)
    folder = FD.scratch_path(spark, "none")
    ev.limit(0).coalesce(1).write.parquet(f"{folder}/tmp")
    tasks = spark.createDataFrame([(1, None, None), (2, "u1", "b")], TASKS)
    assert FD.subscription_stream(spark, folder, tasks, FD.scratch_path(spark, "subs")).count() == 0
    payload = FD.notification_stream(spark, files, tasks, FD.scratch_path(spark, "out")).first().payload
    assert json.loads(payload)["user_id"] == "u1" and json.loads(payload)["task_name"] is None
