"""Stored stream tables: only touched buckets are written, versions can be written again, readers see whole ones."""

import os

from pyspark.sql import functions as F

from tests.test_stateful import event_files
from tidemark.operators.analytics import user_statistics
from tidemark.operators.mutations import change_feed_from_events
from tidemark.operators.search import search_postings
from tidemark.sources.tables import load_views
from tidemark.streaming import feeds as FD
from tidemark.streaming.buckets import BucketStore

SF = "/root/testdata/sf0.001"


def folders(root, version, name):
    local = root[len("file:"):] if root.startswith("file:") else root
    path = f"{local}/v{version}/{name}"
    return {int(x.split("=")[1]) for x in os.listdir(path) if x.startswith("bucket=")} if os.path.isdir(path) else set()


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_batch_on_one_task_rewrites_one_bucket(spark):
    t, _ = load_views(spark, SF)
    ids = sorted(r.id for r in t.select("id").collect())
    first, second = ids[3], ids[40]
    # event e is a change of task e + 1: an archived task, then a deleted one, then a task that is not there
    root = event_files(spark, [[(first - 1, 10, 1, "purchase")], [(second - 1, 20, 2, "error")], [(10**9, 30, 3, "click")]])
    out, out2, out3 = (FD.scratch_path(spark, n) for n in ("list", "postings", "stats"))
    feed = change_feed_from_events(FD.read_event_stream(spark, root).sparkSession.read.schema(FD.EVENT_SCHEMA).parquet(root))
    want = FD.apply_changes(t, feed)
    got = FD.live_task_list(spark, root, t, out, max_files=1)
    assert rows(got) == rows(want.select(*got.columns))
    postings = FD.search_vector_stream(spark, root, t, out2, max_files=1)
    assert rows(postings) == rows(search_postings(want).select(*postings.columns))
    stats = FD.stream_user_statistics(spark, root, t, out3, max_files=1)
    assert rows(stats) == rows(user_statistics(want).select(*stats.columns))
    store = BucketStore(spark, out, {"tasks": "id"})
    one, two = (store.of(spark.createDataFrame([(i,)], "id long"), "id") for i in (first, second))
    assert len(folders(out, 0, "tasks")) > 20
    for o, names in ((out, ["tasks"]), (out2, ["tasks", "postings"]), (out3, ["tasks"])):
        for name in names:
            assert folders(o, 1, name) == set(one) and folders(o, 2, name) == set(two)
    assert len(folders(out3, 1, "statistics")) == 1


def test_a_version_is_written_again_and_found_again(spark):
    root = FD.scratch_path(spark, "store")
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    store = BucketStore(spark, root, {"a": "k", "b": "k"}, buckets=5)
    assert store.version == -1 and store.read("a", "k string, v int").count() == 0
    many = frame(*[(f"k{i}", i) for i in range(40)], (None, -1))
    store.write(0, {"a": (many, None), "b": (many.limit(0), None)})
    touched = store.of(frame(("k7", 0)), "k")
    for _ in range(2):  # the same batch twice, as after a crash before its commit
        store.at(0)
        own = store.read("a", many.schema, touched)
        store.write(1, {"a": (own.withColumn("v", F.col("v") + 100), touched)})
    again = BucketStore(spark, root, {"a": "k", "b": "k"})
    assert again.version == 1 and again.buckets == 5 and again.read("b", many.schema).count() == 0
    hit = {r.k for r in own.collect()}
    assert "k7" in hit and {(r.k, r.v) for r in again.read("a", many.schema).collect()} == {
        (r.k, r.v + (100 if r.k in hit else 0)) for r in many.collect()}
    # a bucket that loses all its rows is gone, and comes back
    again.write(2, {"a": (own.limit(0), touched)})
    assert {r.k for r in again.read("a", many.schema).collect()} == {r.k for r in many.collect()} - hit
    again.write(3, {"a": (frame(("k7", 1)), touched)})
    assert BucketStore(spark, root, {"a": "k"}).read("a", many.schema, touched).collect() == [("k7", 1)]
    again.at(1)
    assert again.read("a", many.schema).count() == 41
