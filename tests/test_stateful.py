"""Keyed state over several micro-batches: the row before a change, and cache answers that expire."""

import datetime as dt
import json
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import mutations as M
from tidemark.sources.tables import load_views, read_table
from tidemark.streaming import feeds as FD

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def small_batches(spark):
    """Arrow batches of 20 rows, so that a busy key's micro-batch goes through the state store slot by slot."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "20")
    yield
    spark.conf.set(key, before)


def event_files(spark, batches):
    """A folder with one events*.parquet file per batch of (event_id, seconds, user_id, event_type)."""
    root = FD.scratch_path(spark, "events")
    local = root[len("file:"):] if root.startswith("file:") else root
    os.makedirs(local)
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
                        ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    for i, rows in enumerate(batches):
        rows = [(e, T0 + dt.timedelta(seconds=s), u, k, 0.0, None) for e, s, u, k in rows]
        pq.write_table(pa.table([list(c) for c in zip(*rows)], schema=schema), f"{local}/events-{i}.parquet")
        time.sleep(1.1)  # file sources order new files by modification time
    return root


def walk(changes, stored):
    """Brute force: (event, op, new user, old user, text) of each change in order."""
    row, out = dict(stored), {}
    for e, _, op, task, user in sorted(changes, key=lambda c: (c[1], c[0])):
        old = row.get(task, (None, None))
        out[e] = (op, None if op == "DELETE" else user, old[0], old[1])
        row[task] = (None, None) if op == "DELETE" else (user, old[1])
    return out


def test_one_task_over_several_batches(spark):
    """Insert, update and delete of one task, and of a stored one, in three micro-batches."""
    batches = [[(0, 0, 1, "signup"), (8, 5, 2, "click")], [(1, 10, 2, "click"), (2, 20, 3, "error"), (9, 12, 3, "error")],
               [(3, 30, 4, "signup"), (10, 31, 5, "signup"), (11, 32, 5, "error")]]
    tasks = spark.createDataFrame([(3, "u9", "stored")], "id long, user_id string, task string")
    root = event_files(spark, batches)
    payload = {r.event_id: json.loads(r.payload) for r in FD.notification_stream(
        spark, root, tasks, FD.scratch_path(spark, "out"), max_files=1, per_task=4).collect()}
    assert {e: (p["operation"], p["user_id"], p["task_id"], p["task_name"]) for e, p in payload.items()} == {
        0: ("INSERT", "u1", 1, None), 1: ("UPDATE", "u2", 1, None), 2: ("DELETE", "u2", 1, None), 3: ("INSERT", "u4", 1, None),
        8: ("UPDATE", "u2", 3, "stored"), 9: ("DELETE", "u2", 3, "stored"), 10: ("INSERT", "u5", 3, None),
        11: ("DELETE", "u5", 3, None)}
    got = FD.subscription_stream(spark, root, tasks, FD.scratch_path(spark, "subs"), max_files=1, per_task=4)
    assert {(r.subscriber, r.event_id) for r in got.collect()} == {
        ("u1", 0), ("u2", 1), ("u1", 1), ("u2", 2), ("u4", 3), ("u2", 8), ("u9", 8), ("u2", 9), ("u5", 10), ("u5", 11)}


def test_busy_tasks_in_many_batches_and_partitions(spark, small_batches):
    """Stream and batch agree with a walk over all changes where a few tasks take most of them."""
    rng = random.Random(8)
    rows = [(e, rng.randrange(4000), rng.randrange(6), rng.choice(["signup", "error", "click", "purchase"]))
            for e in range(600)]
    rows.sort(key=lambda r: r[1])
    tasks = spark.createDataFrame([(1, "u3", "first"), (2, None, "second"), (2, "u1", "b"), (99, "u1", "c"), (None, "u1", "d")],
                                  "id long, user_id string, task string")
    stored = {1: ("u3", "first"), 2: (None, "second"), 99: ("u1", "c")}
    op = {"signup": "INSERT", "error": "DELETE"}
    want = walk([(e, s, op.get(k, "UPDATE"), e // 300 + 1, f"u{u}") for e, s, u, k in rows], stored)
    root = event_files(spark, [rows[:250], rows[250:500], rows[500:]])
    feed = M.change_feed_from_events(spark.read.schema(EVENTS).parquet(root), 300)
    batch = M.previous_rows(feed, tasks)
    assert {r.event_id: (r.operation, None if r.operation == "DELETE" else r.user_id, r.old_user, r.old_task)
            for r in batch.collect()} == want
    as_text = {e: (o, new if new is not None else old, text) for e, (o, new, old, text) in want.items()}
    for got in (M.change_notifications(feed, tasks),
                FD.notification_stream(spark, root, tasks, FD.scratch_path(spark, "out"), max_files=1, per_task=300)):
        payload = {r.event_id: json.loads(r.payload) for r in got.collect()}
        assert {e: (p["operation"], p["user_id"], p["task_name"]) for e, p in payload.items()} == as_text
    assert M.previous_rows(feed.limit(0), tasks).count() == 0
    assert M.previous_rows(feed, tasks.limit(0)).where("old_task is not null").count() == 0


def test_texts_of_the_feed_are_handed_on(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), op, 1, "u1", False, text) for i, (op, text) in enumerate(
        [("INSERT", "one"), ("UPDATE", None), ("UPDATE", "two"), ("UPDATE", None), ("DELETE", None), ("INSERT", None)])]
    feed = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, operation string, task_id long, user_id string, "
                                       "archived boolean, task string")
    tasks = spark.createDataFrame([(1, "u0", "zero")], "id long, user_id string, task string")
    got = {r.event_id: (r.old_user, r.old_task) for r in M.previous_rows(feed, tasks).collect()}
    assert got == {0: ("u0", "zero"), 1: ("u1", "one"), 2: ("u1", "one"), 3: ("u1", "two"), 4: ("u1", "two"), 5: (None, None)}
    names = {r.event_id: json.loads(r.payload)["task_name"] for r in M.change_notifications(feed, tasks).collect()}
    assert names == {0: "one", 1: "one", 2: "two", 3: "two", 4: "two", 5: None}


def state_keys(spark, out):
    got = (spark.read.format("statestore").option("path", f"{out}-checkpoint").option("stateVarName", "last").load())
    return {r[0] for r in got.select("key.key").collect()}


def test_answers_expire_and_the_state_shrinks(spark, small_batches):
    """Forty keys, then quiet keys: their state goes once the watermark has passed; the result is that of the batch fold."""
    rng = random.Random(6)
    first = sorted((rng.randrange(900), f"k{i % 40}") for i in range(200)) + [(950, "busy")] * 3
    later = sorted((20000 + rng.randrange(3000), "busy") for _ in range(120))
    last = [(40000, "end"), (40001, "end")]
    rows = [[(n * 1000 + i, s, 0, k) for i, (s, k) in enumerate(part)] for n, part in enumerate((first, later, last))]
    root = event_files(spark, rows)
    out = FD.scratch_path(spark, "ttl")
    got = {r.event_id: r.is_miss for r in FD.ttl_dedup_streaming_run(spark, root, max_files=1, out=out).collect()}
    want = {r.event_id: r.is_miss for r in
            FD.ttl_dedup(spark.read.schema(EVENTS).parquet(root), "event_type").collect()}
    assert got == want and len(got) == 325
    assert state_keys(spark, out) == {"end"}


def test_late_requests_are_left_out(spark):
    """Behind the watermark of the last micro-batch but one: no answer; in time for it: folded as usual."""
    root = event_files(spark, [[(1, 0, 0, "a"), (2, 5000, 0, "b")], [(3, 4900, 0, "a"), (4, 5100, 0, "b")],
                               [(5, 10, 0, "a"), (6, 4950, 0, "a"), (7, 5300, 0, "b")]])
    got = {r.event_id: r.is_miss for r in FD.ttl_dedup_streaming_run(spark, root, max_files=1).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 6: False, 7: True}


def test_streams_agree_with_batch_on_the_given_events(spark):
    t, _ = load_views(spark, SF)
    feed = M.change_feed_from_events(read_table(spark, SF, "events"), 7)
    want = {(r.event_id, r.payload) for r in M.change_notifications(feed, t).collect()}
    got = FD.notification_stream(spark, SF, t, FD.scratch_path(spark, "given"), per_task=7)
    assert {(r.event_id, r.payload) for r in got.collect()} == want
    assert got.agg(F.count("*")).first()[0] == 1000
