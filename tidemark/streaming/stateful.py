"""Keyed state of the response cache (J6): each cache key's last miss.

It is a ``transformWithState`` processor, whose state lies in the RocksDB
state store and is restored after a restart. The rows of one key in a
micro-batch arrive unsorted; they are put in (time, id) order a slot of time
at a time, so a busy key is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts_col: str) -> Column:
    """Microseconds since 1970 of a wall-clock time."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts_col))


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store; a provider set by the cluster that has its name is kept."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_order(rows: Iterator[pd.DataFrame], pending, slot_us: int) -> Iterator[pd.DataFrame]:
    """The rows of one key in (ts_us, event_id) order, a part at a time.

    One Arrow batch is sorted as it is. More are dealt by slots of time into
    the map state ``pending``, which is on disk, and come back slot by slot: at
    most one batch and one slot are in memory.
    """
    rows = (pdf for pdf in rows if len(pdf))
    first, second = next(rows, None), next(rows, None)
    if first is None:
        return
    by_time = ["ts_us", "event_id"]
    if second is None:
        yield first.sort_values(by_time, kind="mergesort")
        return
    parts: dict[int, int] = {}
    for pdf in chain([first, second], rows):
        for slot, own in pdf.groupby(pdf["ts_us"] // slot_us):
            n = parts.get(slot, 0)
            table = pa.Table.from_pandas(own, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            pending.updateValue((int(slot), n), (sink.getvalue().to_pybytes(),))
            parts[slot] = n + 1
    for slot in sorted(parts):
        held = []
        for n in range(parts[slot]):
            held.append(pa.ipc.open_stream(pending.getValue((int(slot), n))[0]).read_pandas())
            pending.removeKey((int(slot), n))
        yield pd.concat(held, ignore_index=True).sort_values(by_time, kind="mergesort")


# --------------------------------------------------------------------------
# The response cache with expiry
# --------------------------------------------------------------------------

class CacheWindow(StatefulProcessor):
    """A key's last miss, dropped by a timer once its time to live has passed."""

    def __init__(self, ttl_us: int, fold: Callable):
        self.ttl_us, self.fold = ttl_us, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "miss_us long")
        self.pending = handle.getMapState("pending", "slot long, part int", "rows binary")

    def _expiry_ms(self, miss_us: int) -> int:
        return -(-(miss_us + self.ttl_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        last = before
        for pdf in in_order(rows, self.pending, self.ttl_us):
            miss, last = self.fold(pdf["ts_us"].to_numpy(np.int64), self.ttl_us, last)
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "key": key[0], "is_miss": miss})
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry_ms(before))
            self.last.update((last,))
            self.handle.registerTimer(self._expiry_ms(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self._expiry_ms(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, key: str, ts_col: str, id_col: str, ttl_us: int, delay: str, fold: Callable,
                 out) -> DataFrame:
    """The cache fold over a stream, see ``feeds.ttl_dedup_stream``."""
    use_rocksdb(events.sparkSession)
    ev = (events.select(F.col(id_col).alias("event_id"), F.col(key).cast("string").alias("key"), micros(ts_col).alias("ts_us"),
                        F.col(ts_col).cast("timestamp").alias("at"))
          .where(F.col("key").isNotNull() & F.col("ts_us").isNotNull()).withWatermark("at", delay))
    return ev.groupBy("key").transformWithStateInPandas(CacheWindow(ttl_us, fold), out, "Append", "EventTime")
