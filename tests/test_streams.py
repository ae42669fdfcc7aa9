"""Streaming jobs over several micro-batches agree with their batch forms.

The sf0.001 event log is split into three time-ordered files in a scratch
folder and read with maxFilesPerTrigger=1, so state must carry across
micro-batches (the cache fold's per-key state, the versioned snapshots).
"""

import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.analytics import user_statistics
from tidemark.operators.mutations import change_feed_from_events
from tidemark.sources.tables import load_views, read_table
from tidemark.streaming import feeds as FD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events(spark):
    ev = read_table(spark, SF, "events")
    cuts = ev.approxQuantile("event_id", [1 / 3, 2 / 3], 0.0)
    folder = FD.scratch_path(spark, "events-split")
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    bounds = [(None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)]
    for i, (lo, hi) in enumerate(bounds):
        part = ev
        if lo is not None:
            part = part.where(F.col("event_id") > lo)
        if hi is not None:
            part = part.where(F.col("event_id") <= hi)
        part.coalesce(1).write.parquet(f"{folder}/tmp{i}")
        src = [f for f in os.listdir(f"{local}/tmp{i}") if f.endswith(".parquet")][0]
        os.replace(f"{local}/tmp{i}/{src}", f"{local}/events-{i}.parquet")
        time.sleep(1.1)  # file sources order new files by modification time
    return folder


def test_ttl_stream_state_across_batches(spark, split_events):
    streamed = {r.event_id: r.is_miss for r in
                FD.ttl_dedup_streaming_run(spark, split_events, "event_type", max_files=1).collect()}
    batch = {r.event_id: r.is_miss for r in
             FD.ttl_dedup(read_table(spark, SF, "events"), "event_type").collect()}
    assert len(streamed) == len(batch) == 1000
    assert streamed == batch


def test_ttl_busy_key_is_folded_in_many_tasks(spark, monkeypatch):
    """A key with requests in every window, one with pauses and one with a single request, over several levels."""
    import datetime as dt
    import random
    monkeypatch.setattr(FD, "BLOCK_TTLS", 2)
    monkeypatch.setattr(FD, "FAN", 3)
    rng = random.Random(5)
    busy = [(f"busy{k}", rng.randrange(300 * 90)) for k in (0, 1) for _ in range(2000)]
    even = [("even", 100 * i) for i in range(300)]
    slow = [("slow", rng.randrange(300 * 90)) for _ in range(25)]
    rows = [(i, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s))
            for i, (k, s) in enumerate([*busy, *even, *slow, ("once", 300 * 89), ("once", 300 * 89)])]
    rows += [(10**6, None, dt.datetime(2024, 1, 1)), (10**6 + 1, "busy0", None)]
    ev = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz")
    last, want = {}, {}
    for i, k, t in sorted((r for r in rows[:-2]), key=lambda r: (r[2], r[0])):
        want[i] = k not in last or t >= last[k] + dt.timedelta(minutes=5)
        if want[i]:
            last[k] = t
    out = FD.ttl_dedup(ev, "event_type")
    assert {r.event_id: r.is_miss for r in out.collect()} == want
    tasks = out.where("key = 'busy0'").select(F.spark_partition_id()).distinct()
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # AQE would join these few rows into one task
    try:
        assert tasks.count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    assert FD.ttl_dedup(ev.limit(0), "event_type").count() == 0


def test_stats_stream_matches_batch(spark, split_events):
    t, _ = load_views(spark, SF)
    out = FD.scratch_path(spark, "stats")
    streamed = FD.stream_user_statistics(spark, split_events, t, out, max_files=1)
    feed = change_feed_from_events(read_table(spark, SF, "events"))
    expected = user_statistics(FD.apply_changes(t, feed))
    cols = expected.columns
    assert sorted(map(tuple, streamed.select(*cols).collect())) == sorted(map(tuple, expected.collect()))


def test_search_reads_the_postings_that_the_stream_keeps(spark, split_events):
    from tidemark.operators import search as S
    from tidemark.plans.q_search import user_queries
    t, p = load_views(spark, SF)
    stored = FD.search_vector_stream(spark, split_events, t, FD.scratch_path(spark, "postings"), max_files=1)
    now = FD.apply_changes(t, change_feed_from_events(read_table(spark, SF, "events")))
    got = S.search_stored(stored, now, p, user_queries(t)).collect()
    want = S.search_tasks(now, p, user_queries(t)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_changes_insert_update_delete(spark):
    import datetime as dt
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    t = spark.createDataFrame([(i, f"t{i}", False, "u1", at(0), at(0)) for i in range(1, 6)],
                              "id long, task string, archived boolean, user_id string, created_at timestamp_ntz, "
                              "updated_at timestamp_ntz")
    feed = spark.createDataFrame(
        [(1, at(1), "UPDATE", 1, "u1", True), (2, at(2), "UPDATE", 1, "u1", False), (3, at(3), "DELETE", 2, "u1", False),
         (4, at(4), "INSERT", 9, "u2", False), (5, at(5), "INSERT", 3, "u2", False), (6, at(6), "DELETE", 77, "u1", False),
         (7, at(7), "UPDATE", 4, "u1", True), (8, at(8), "DELETE", 4, "u1", False)],
        "event_id long, ts timestamp_ntz, operation string, task_id long, user_id string, archived boolean")
    got = {r.id: r for r in FD.apply_changes(t, feed).collect()}
    assert sorted(got) == [1, 3, 5, 9]
    assert (got[1].archived, got[1].updated_at) == (False, at(2))
    assert got[3] == t.where("id = 3").first() and got[9].user_id == "u2" and got[9].created_at == at(4)


def test_stream_goes_on_after_a_restart(spark, split_events):
    """Stop after the first two files, start again on the same folder: only the new file is applied."""
    t, _ = load_views(spark, SF)
    folder, root = FD.scratch_path(spark, "events-late"), FD.scratch_path(spark, "restart")
    strip = lambda p: p[len("file:"):] if p.startswith("file:") else p
    os.makedirs(strip(folder))

    def arrive(i):
        with open(f"{strip(split_events)}/events-{i}.parquet", "rb") as src, open(f"{strip(folder)}/events-{i}.parquet", "wb") as dst:
            dst.write(src.read())
    arrive(0)
    FD.live_task_list(spark, folder, t, root, archived=False)
    arrive(1)
    FD.live_task_list(spark, folder, t, root, archived=False)
    arrive(2)
    got = FD.live_task_list(spark, folder, t.limit(0), root, archived=False)  # the start table is not read again
    feed = change_feed_from_events(read_table(spark, SF, "events"))
    want = FD.apply_changes(t, feed).where("not archived")
    assert {(r.id, r.updated_at) for r in got.collect()} == {(r.id, r.updated_at) for r in want.collect()}
    assert sorted(x for x in os.listdir(strip(root)) if x.startswith("v")) == ["v0", "v1", "v2", "v3"]
