"""Statistics by signed deltas: equal to a full rebuild after any run of inserts, updates and deletes."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tests.test_buckets import folders, rows
from tidemark.operators.analytics import user_statistics
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.tables import load_views
from tidemark.streaming import feeds as FD
from tidemark.streaming import statistics as ST
from tidemark.streaming.buckets import BucketStore

SF = "/root/testdata/sf0.001"
TASKS = ("id long, user_id string, project_id string, archived boolean, ai_enhanced boolean, "
         "created_at timestamp_ntz, updated_at timestamp_ntz")


def a_row(rng, i):
    """A task of a hot user, others or nobody, with nulls everywhere."""
    at = lambda: rng.choice([None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(20) * 40000)])
    flag = lambda: rng.choice([True, False, None])
    return (i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice(["p1", "p2", "p3", "", None]), flag(), flag(),
            at(), at())


def started(spark, name, tasks, buckets=8):
    ensure_checkpoint_dir(spark)
    start = ST.start_tables(tasks)
    store = BucketStore(spark, FD.scratch_path(spark, name), ST.KEYS, buckets)
    store.write(0, {n: (df, None) for n, df in start.items()})
    return store, {n: df.schema for n, df in start.items()}


def test_random_changes_equal_a_rebuild(spark):
    """Rows come, change in any column (their user too) and go; copies of a row count each."""
    rng = random.Random(5)
    frame = lambda rs: spark.createDataFrame(rs, TASKS).coalesce(1)
    table = {i: [a_row(rng, i)] for i in range(60)}
    table[7] *= 2
    flat = lambda t: [r for rs in t.values() for r in rs]
    store, schemas = started(spark, "random", frame(flat(table)))
    for version in range(1, 4):
        before, after = [], []
        for i in rng.sample(range(80), 25):
            new = rng.choice([[], [a_row(rng, i)], table.get(i, [])])
            before, after = before + table.get(i, []), after + new
            table[i] = new
        store.write(version, ST.apply_deltas(store, schemas, frame(before), frame(after)))
        want = user_statistics(frame(flat(table)))
        assert rows(store.read("statistics", schemas["statistics"])) == rows(want)
    # the kept tables are those that a start from the present rows makes
    for name, df in ST.start_tables(frame(flat(table))).items():
        assert rows(store.read(name, schemas[name]).select(*df.columns)) == rows(df), name
    gone = flat(table)
    store.write(4, ST.apply_deltas(store, schemas, frame(gone), frame(gone).limit(0)))
    assert all(store.read(n, s).count() == 0 for n, s in schemas.items())
    store.write(5, ST.apply_deltas(store, schemas, frame(gone).limit(0), frame(gone)))
    assert rows(store.read("statistics", schemas["statistics"])) == rows(user_statistics(frame(gone)))


def test_a_change_of_a_busy_user_touches_few_buckets(spark):
    """One user with all rows: one archived task reads and writes one user bucket and one slot bucket."""
    t0 = dt.datetime(2024, 1, 1)
    all_rows = [(i, "hot", f"p{i % 40}", False, False, t0 + dt.timedelta(hours=7 * i), t0) for i in range(600)]
    tasks = spark.createDataFrame(all_rows, TASKS)
    store, schemas = started(spark, "busy", tasks, buckets=32)
    assert len(folders(store.root, 0, "values")) > 25  # the user's slots lie in all buckets
    old = spark.createDataFrame([all_rows[599]], TASKS)
    new = old.withColumn("archived", F.lit(True)).withColumn("updated_at", F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    store.write(1, ST.apply_deltas(store, schemas, old, new))
    assert [len(folders(store.root, 1, n)) for n in ("totals", "values", "peaks", "statistics")] == [1, 1, 1, 1]
    # the newest task goes: the maximum falls back to the one before it, from the peaks alone
    store.write(2, ST.apply_deltas(store, schemas, new, new.limit(0)))
    got = store.read("statistics", schemas["statistics"]).collect()
    assert got == user_statistics(tasks.where("id <> 599")).collect()
    assert got[0].last_task_created == all_rows[598][5] and got[0].last_task_completed is None


def test_the_stream_over_many_batches(spark):
    from tests.test_stateful import event_files
    t, _ = load_views(spark, SF)
    rng = random.Random(9)
    kinds = ["signup", "error", "click", "purchase"]
    batches = [[(rng.randrange(400), 100 * b + k, rng.randrange(9), rng.choice(kinds)) for k in range(60)] for b in range(2)]
    # ids are unique in a log, so the last of equal ones holds
    batches = [list({e[0]: e for e in b}.values()) for b in batches]
    root = event_files(spark, batches)
    got = FD.stream_user_statistics(spark, root, t, FD.scratch_path(spark, "stats"), max_files=1)
    now = t
    feeds = [spark.read.schema(FD.EVENT_SCHEMA).parquet(f"{root}/{f}") for f in sorted(
        os.listdir(root[len("file:"):] if root.startswith("file:") else root)) if f.endswith(".parquet")]
    for feed in feeds:
        now = FD.apply_changes(now, FD.change_feed_from_events(feed)).checkpoint()
    assert rows(got) == rows(user_statistics(now).select(*got.columns))
