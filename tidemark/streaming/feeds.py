"""Change-feed streams and stateful jobs.

Sources are Structured Streaming reads of the event log; each job is
``readStream -> transformations -> writeStream``. A job lives in one folder
that its caller names: stream checkpoint, stored versions and the pointer to
the current one. Micro-batch ``n`` reads version ``n`` and writes version
``n + 1``, so a batch that runs again writes the same version again, and a job
started again on its folder goes on where it stopped. Jobs that update stored
tables (live lists, postings, statistics, last rows) use ``foreachBatch``.

The response cache (J6) needs an ordered fold per key; in streaming it is
a keyed state with a timer (``stateful``), and in
batch all blocks of time are folded at once (see ``ttl_dedup``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rules import CACHE_TTL_SECONDS
from tidemark.operators.analytics import user_statistics
from tidemark.operators.lists import task_list
from tidemark.operators.mutations import change_feed_from_events, notifications, rows_before, stored_rows, subscribers
from tidemark.operators.search import search_postings
from tidemark.session import ensure_checkpoint_dir
from tidemark.streaming import statistics as ST
from tidemark.streaming.buckets import BucketStore
from tidemark.streaming.stateful import cache_stream

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The event log as a stream (A9 source): the parquet file(s) named events*.parquet."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def change_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, per_task: int = 1) -> DataFrame:
    """A9/J5 source: the task change feed as a stream."""
    return change_feed_from_events(read_event_stream(spark, sf_dir, max_files), per_task)


def run_buckets(stream: DataFrame, root: str, tables: dict[str, tuple[DataFrame, str | tuple]], step) -> dict[str, DataFrame]:
    """Run a ``foreachBatch`` job over bucketed tables in folder ``root`` over everything available, then stop.

    ``tables`` = {name: (start rows, key column)} are written once.
    ``step(store, changes)`` returns the buckets that a micro-batch changes, as BucketStore.write()
    takes them: all others stay where they are. The pointer is written after
    the version it names, so readers never see a version in the making.
    """
    spark = stream.sparkSession
    store = BucketStore(spark, root, {name: key for name, (_, key) in tables.items()})
    if store.version < 0:
        store.write(0, {name: (df, None) for name, (df, _) in tables.items()})

    def batch(changes: DataFrame, epoch: int) -> None:
        store.at(epoch)
        store.write(epoch + 1, step(store, changes))

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    done = BucketStore(spark, root, store.keys)
    return {name: done.read(name, df.schema) for name, (df, _) in tables.items()}


def refresh_user_statistics(tasks: DataFrame, path: str) -> DataFrame:
    """Rebuild the stored per-user statistics at ``path`` and read them back.

    The refresh writes a complete new copy (overwrite), like REFRESH
    MATERIALIZED VIEW; readers of the returned frame see the stored table.
    """
    spark = tasks.sparkSession
    user_statistics(tasks).repartition("user_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each task in ``changes`` by (ts, event_id)."""
    return (changes.groupBy(F.col("task_id").alias("_tid"))
            .agg(F.max_by(F.struct("operation", "archived", "user_id", "ts"), F.struct("ts", "event_id")).alias("_l")))


def apply_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply the last change of each task: UPDATE sets archived and updated_at, DELETE drops the
    row, INSERT appends one (a stored id stays as it is)."""
    j = snapshot.join(last_changes(changes), F.col("id") == F.col("_tid"), "full")
    op = F.col("_l.operation")
    known = F.col("id").isNotNull()
    keep = known & ~F.coalesce(op == "DELETE", F.lit(False)) | ~known & (op == "INSERT")
    upd = known & F.coalesce(op == "UPDATE", F.lit(False))
    new = {"id": F.col("_tid"), "user_id": F.col("_l.user_id"), "archived": F.lit(False),
           "created_at": F.col("_l.ts"), "updated_at": F.col("_l.ts")}
    cols = []
    for c in snapshot.columns:
        value = F.col(c)
        if c in ("archived", "updated_at"):
            value = F.when(upd, F.col("_l.archived" if c == "archived" else "_l.ts")).otherwise(value)
        if c in new:
            value = F.when(known, value).otherwise(new[c].cast(snapshot.schema[c].dataType))
        cols.append(value.alias(c))
    return j.where(keep).select(*cols)


def live_task_list(spark: SparkSession, sf_dir: str, tasks: DataFrame, root: str,
                   max_files: int | None = None, **filters) -> DataFrame:
    """Keep a filtered task list current from the change stream (folder ``root``).

    A micro-batch reads and rewrites the buckets of the tasks that it names.
    """
    def step(store: BucketStore, changes: DataFrame) -> dict:
        touched = store.of(changes, "task_id")
        return {"tasks": (apply_changes(store.read("tasks", tasks.schema, touched), changes), touched)}
    got = run_buckets(change_stream(spark, sf_dir, max_files), root, {"tasks": (tasks, "id")}, step)
    return task_list(got["tasks"], order=False, **filters)


def search_vector_stream(spark: SparkSession, sf_dir: str, tasks: DataFrame, root: str,
                         max_files: int | None = None) -> DataFrame:
    """Keep the postings current: those of the tasks that a micro-batch names are dropped and
    built again from the changed tasks; deleted tasks keep none. Postings lie in the buckets of
    their tasks, so the buckets of the named tasks are all that is read and rewritten."""
    start = search_postings(tasks)

    def step(store: BucketStore, changes: DataFrame) -> dict:
        touched = store.of(changes, "task_id")
        ids = changes.select(F.col("task_id").alias("id")).distinct()
        now = apply_changes(store.read("tasks", tasks.schema, touched), changes)
        fresh = search_postings(now.join(ids, "id", "left_semi"))
        kept = store.read("postings", start.schema, touched).join(ids, "id", "left_anti")
        return {"tasks": (now, touched), "postings": (kept.select(*start.columns).unionByName(fresh), touched)}
    return run_buckets(change_stream(spark, sf_dir, max_files), root,
                       {"tasks": (tasks, "id"), "postings": (start, "id")}, step)["postings"]


def stream_user_statistics(spark: SparkSession, sf_dir: str, tasks: DataFrame, root: str,
                           max_files: int | None = None) -> DataFrame:
    """Keep the stored statistics current by signed deltas (``statistics``).

    A batch takes the named tasks' old contributions away and adds their new ones;
    no other row of a user is read. Only the buckets of the named tasks, their
    users and the value slots that change are read and rewritten.
    """
    start = ST.start_tables(tasks)
    schemas = {name: df.schema for name, df in start.items()}

    def step(store: BucketStore, changes: DataFrame) -> dict:
        touched = store.of(changes, "task_id")
        ids = changes.select(F.col("task_id").alias("id")).distinct()
        before = store.read("tasks", tasks.schema, touched)
        now = apply_changes(before, changes).checkpoint()  # read twice
        own = ST.apply_deltas(store, schemas, before.join(ids, "id", "left_semi"), now.join(ids, "id", "left_semi"))
        return {"tasks": (now, touched), **own}
    ensure_checkpoint_dir(spark)
    return run_buckets(change_stream(spark, sf_dir, max_files), root, {
        "tasks": (tasks, "id"), **{name: (df, ST.KEYS[name]) for name, df in start.items()}}, step)["statistics"]


def change_deliveries(stream: DataFrame, tasks: DataFrame, root: str, out_path: str, kind: str, deliver) -> DataFrame:
    """A9/J4/J5 sink: ``deliver`` of the changes, each with the task's row before it, appended to ``out_path``.

    The last row of each task is a bucketed table in folder ``root`` that starts with
    ``tasks``, so changes of one task over several micro-batches see each other; a deleted task
    keeps none. A micro-batch sorts out its own changes in one ``rows_before`` and
    rewrites the buckets of the tasks that it names. Its rows are one folder of the sink, which a
    batch that runs again writes again. Returns what the sink holds of finished batches.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    start = stored_rows(tasks)
    # changes without a time come last
    time = [c for name in ("ts", "event_id") for c in (F.col(name).isNull(), F.col(name))]

    def step(store: BucketStore, changes: DataFrame) -> dict:
        touched = store.of(changes, "task_id")
        known = store.read("rows", start.schema, touched)
        rows = rows_before(changes, known, time).checkpoint()  # read twice
        deliver(rows).write.mode("overwrite").format(kind).save(f"{out_path}/batch={store.version}")
        stays = F.col("operation") != "DELETE"
        text = F.coalesce("task", "old_task") if "task" in rows.columns else F.col("old_task")
        now = (rows.groupBy("task_id").agg(F.max_by(F.when(stays, F.struct("user_id", text.alias("task"))),
                                                    F.struct(*time)).alias("_row")))
        named = now.select(F.col("task_id").alias("_named"))
        kept = known.join(named, F.col("task_id").eqNullSafe(F.col("_named")), "left_anti")
        return {"rows": (kept.unionByName(now.where("_row is not null").select("task_id", "_row.*")), touched)}
    run_buckets(stream, root, {"rows": (start, "task_id")}, step)
    done = [f"{out_path}/batch={n}" for n in range(BucketStore(spark, root, {"rows": "task_id"}).version)]
    schema = deliver(stream.withColumns({"old_user": F.col("user_id"), "old_task": F.lit(None).cast("string")})).schema
    return spark.read.schema(schema).format(kind).load(done) if done else spark.createDataFrame([], schema)


def subscription_stream(spark: SparkSession, sf_dir: str, tasks: DataFrame, root: str,
                        max_files: int | None = None, user: str | None = None, per_task: int = 1) -> DataFrame:
    """A9/J5 as a stream: each change to its subscribers (or one ``user``'s), appended to a parquet sink."""
    return change_deliveries(change_stream(spark, sf_dir, max_files, per_task), tasks, root, f"{root}/out", "parquet",
                             lambda rows: subscribers(rows, user=user))


def notification_stream(spark: SparkSession, sf_dir: str, tasks: DataFrame, out_path: str,
                        max_files: int | None = None, per_task: int = 1) -> DataFrame:
    """A10/J4 as a stream: one JSON payload per change, appended to a JSON file
    sink (a message bus sink is a one-line format change)."""
    return change_deliveries(change_stream(spark, sf_dir, max_files, per_task), tasks, f"{out_path}-state", out_path, "json",
                             notifications)


# --------------------------------------------------------------------------
# Response cache with a fixed time-to-live
# --------------------------------------------------------------------------

TTL_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("key", T.StringType()),
                        T.StructField("is_miss", T.BooleanType())])


def _fold(ts_us: np.ndarray, ttl_us: int, last_miss: int | None) -> tuple[np.ndarray, int | None]:
    """Cache fold over sorted times: a miss starts a new TTL window.

    Goes from miss to miss by binary search, so its steps are the misses and
    not the requests.
    """
    out = np.zeros(len(ts_us), dtype=bool)
    at = 0 if last_miss is None else int(np.searchsorted(ts_us, last_miss + ttl_us))
    while at < len(ts_us):
        out[at], last_miss = True, int(ts_us[at])
        at += int(np.searchsorted(ts_us[at:], last_miss + ttl_us))
    return out, last_miss


BLOCK_TTLS = 16       # time-to-live spans in one block of a key's requests
FAN = 32              # neighbouring blocks that make one block of the next level
NEVER = -(1 << 62)    # last miss of a key without one
EXITS = "key string, block long, start_us long, exit_us long"


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Key-sorted batches regrouped so that no key spans two chunks: (rows, first row of each key and the end)."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        if all(pdf[k].iloc[-1] == held[0][k].iloc[0] for k in keys):  # one key so far
            continue
        rows = pd.concat(held, ignore_index=True)
        starts = _first_rows(rows, keys)
        yield rows.iloc[:starts[-2]], starts[:-1]
        held = [rows.iloc[starts[-2]:]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, _first_rows(rows, keys)


def _first_rows(pdf: pd.DataFrame, keys: list[str]) -> list[int]:
    new = np.ones(len(pdf), dtype=bool)
    new[1:] = False
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return [*np.flatnonzero(new), len(pdf)]


def _block_exits(ts_us: np.ndarray, begin: int, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """(first miss, last miss) of a block for every first miss that an earlier window can force.

    A window from before the block ends within its first span, so the first
    miss is a request of that span or the one after it.
    """
    start = ts_us[:np.searchsorted(ts_us, begin + ttl_us) + 1]
    at = start.copy()
    while True:
        nxt = np.searchsorted(ts_us, at + ttl_us)
        go = nxt < len(ts_us)
        if not go.any():
            return start, at
        at[go] = ts_us[nxt[go]]


def _pass(start: np.ndarray, exit_: np.ndarray, miss: np.ndarray, ttl_us: int) -> np.ndarray:
    """Last misses after a block, from the last misses before it."""
    at = np.searchsorted(start, miss + ttl_us)
    inside = at < len(start)  # others: the window covers the whole block
    out = miss.copy()
    out[inside] = exit_[at[inside]]
    return out


def _steps(start: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """Rows that say the same: of neighbouring first misses with one exit only the last is needed."""
    return np.flatnonzero(np.append(exit_[1:] != exit_[:-1], True)) if len(start) else np.zeros(0, int)


def _last_miss_before_blocks(ev: DataFrame, begin: int, blocks: int, ttl_us: int) -> DataFrame:
    """(key, block, miss): the last miss of the key before each of its blocks (NEVER if there is none)."""
    ensure_checkpoint_dir(ev.sparkSession)
    one = span = BLOCK_TTLS * ttl_us

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_groups(batches, ["key", "block"]):
            key, block, ts = (pdf[c].to_numpy() for c in ("key", "block", "ts_us"))
            got = [_block_exits(ts[s:e], begin + int(block[s]) * one, ttl_us)
                   for s, e in zip(starts, starts[1:])]
            yield exit_rows(key, block, starts, got)

    def exit_rows(key, block, starts, got) -> pd.DataFrame:
        kept = [_steps(*g) for g in got]
        n, first = [len(k) for k in kept], starts[:-1]
        return pd.DataFrame({"key": np.repeat(key[first], n), "block": np.repeat(block[first], n),
                             "start_us": np.concatenate([g[0][k] for g, k in zip(got, kept)]),
                             "exit_us": np.concatenate([g[1][k] for g, k in zip(got, kept)])})

    # the way up: one table of steps for each block of each level
    levels = [ev.select("key", "block", "ts_us").repartition("key", "block")
              .sortWithinPartitions("key", "block", "ts_us").mapInPandas(exits, EXITS).checkpoint()]
    while blocks > 1:
        span, blocks = span * FAN, -(-blocks // FAN)

        def merge(batches: Iterator[pd.DataFrame], span=span) -> Iterator[pd.DataFrame]:
            for pdf, starts in _whole_groups(batches, ["key", "parent"]):
                key, parent, block, start, end = (
                    pdf[c].to_numpy() for c in ("key", "parent", "block", "start_us", "exit_us"))
                got = []
                for s, e in zip(starts, starts[1:]):
                    lead = start[s:e][:np.searchsorted(start[s:e], begin + int(parent[s]) * span + ttl_us) + 1]
                    miss = lead - ttl_us
                    parts = s + np.append(np.flatnonzero(np.append(True, block[s + 1:e] != block[s:e - 1])), e - s)
                    for a, b in zip(parts, parts[1:]):
                        miss = _pass(start[a:b], end[a:b], miss, ttl_us)
                    got.append((lead, miss))
                yield exit_rows(key, parent, starts, got)

        levels.append(levels[-1].withColumn("parent", F.floor(F.col("block") / FAN)).repartition("key", "parent")
                      .sortWithinPartitions("key", "parent", "block", "start_us")
                      .mapInPandas(merge, EXITS).checkpoint())

    # the way down: a block's last miss is that of its parent, passed through the blocks before it
    before = levels.pop().select("key", "block").distinct().withColumn("miss", F.lit(NEVER).cast("long"))
    while levels:
        def hand_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf, starts in _whole_groups(batches, ["key", "parent"]):
                key, block, start, end, given = (
                    pdf[c].to_numpy() for c in ("key", "block", "start_us", "exit_us", "miss"))
                rows, misses = [], []
                for s, e in zip(starts, starts[1:]):
                    miss = given[s:s + 1].astype(np.int64)
                    parts = s + np.append(np.flatnonzero(np.append(True, block[s + 1:e] != block[s:e - 1])), e - s)
                    for a, b in zip(parts, parts[1:]):
                        rows.append(a)
                        misses.append(int(miss[0]))
                        miss = _pass(start[a:b], end[a:b], miss, ttl_us)
                yield pd.DataFrame({"key": key[rows], "block": block[rows], "miss": np.array(misses, np.int64)})

        steps = levels.pop().withColumn("parent", F.floor(F.col("block") / FAN))
        before = (steps.join(before.withColumnRenamed("block", "parent"), ["key", "parent"])
                  .repartition("key", "parent").sortWithinPartitions("key", "parent", "block", "start_us")
                  .mapInPandas(hand_on, "key string, block long, miss long"))
    return before


def ttl_dedup(events: DataFrame, key: str, ts_col: str = "ts", id_col: str = "event_id",
              ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """J6 (batch): mark each request as a cache miss or hit.

    A request whose key was answered less than ``ttl_seconds`` after the
    *first* (missing) request of the current window is a hit; hits do not
    extend the window; the first request at or after it expires is a new
    miss. Order is (ts, id). Requests without key or time are left out.

    Exact and parallel in time: a key's requests are cut into blocks of
    ``BLOCK_TTLS`` windows. All that a block needs to know of the past is the
    last miss, and all that it hands on is its own last miss, which depends
    only on its first miss: a table of steps with at most the requests of one
    window. ``FAN`` neighbouring tables make one of the next level, up to one
    block for all time; on the way down every block learns the last miss
    before it. Then all blocks are folded at once: a key that is busy in every
    window is many tasks' work, and a task holds one block's times (or FAN
    tables) while the fold itself goes batch by batch.
    """
    ttl_us = int(ttl_seconds * 1_000_000)
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts_col))
    ev = (events.select(F.col(id_col).alias("event_id"), F.col(key).cast("string").alias("key"), us.alias("ts_us"))
          .where(F.col("key").isNotNull() & F.col("ts_us").isNotNull()))
    begin, end = ev.agg(F.min("ts_us"), F.max("ts_us")).first()
    begin, end = begin or 0, end or 0
    span = BLOCK_TTLS * ttl_us
    ev = ev.withColumn("block", F.expr(f"(ts_us - {begin}) div {span}"))
    before = _last_miss_before_blocks(ev, begin, (end - begin) // span + 1, ttl_us)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted, each block led by its last miss; state is carried across batches
        last = None
        for pdf in batches:
            lead, ts = pdf["lead"].to_numpy(bool), pdf["ts_us"].to_numpy(np.int64)
            miss = np.zeros(len(pdf), dtype=bool)
            starts = [0, *np.flatnonzero(lead), len(pdf)]
            for s, e in zip(starts, starts[1:]):
                if e > s and lead[s]:
                    last, s = int(ts[s]), s + 1
                if e > s:
                    miss[s:e], last = _fold(ts[s:e], ttl_us, last)
            yield pdf.assign(is_miss=miss).loc[~lead, ["event_id", "key", "is_miss"]]

    leads = before.select(F.lit(0).cast("long").alias("event_id"), "key", F.col("miss").alias("ts_us"), "block",
                          F.lit(True).alias("lead"))
    ordered = (ev.withColumn("lead", F.lit(False)).unionByName(leads).repartition("key", "block")
               .sortWithinPartitions("key", "block", F.desc("lead"), "ts_us", "event_id"))
    return ordered.mapInPandas(fold, TTL_OUT)


def ttl_dedup_stream(events: DataFrame, key: str, ts_col: str = "ts", id_col: str = "event_id",
                     ttl_seconds: int = CACHE_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """J6 (stream): the same fold with one timestamp of state per key that expires.

    The watermark lags the newest request by ``delay``. Requests behind the
    watermark of the last micro-batch but one come too late: their answers may
    be gone, and they are left out. All others are folded in time order across
    micro-batches if the log is in order, and within a micro-batch always. A
    timer drops a key's state once the watermark has passed its time to live;
    what comes later would be a miss anyway, so the result is that of ttl_dedup().
    """
    return cache_stream(events, key, ts_col, id_col, int(ttl_seconds * 1_000_000), delay, _fold, TTL_OUT)


def ttl_dedup_streaming_run(spark: SparkSession, sf_dir: str, key: str = "event_type",
                            max_files: int | None = None, out: str | None = None,
                            delay: str = "10 minutes") -> DataFrame:
    """Run the streaming cache fold over the event log into a parquet sink and read it back.

    ``out`` names the sink of a job that is started again; without it the job is a new one.
    """
    out = out or scratch_path(spark, "ttl-out")
    stream = ttl_dedup_stream(read_event_stream(spark, sf_dir, max_files), key, delay=delay)
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", f"{out}-checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(TTL_OUT).parquet(out)
