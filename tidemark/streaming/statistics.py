"""Per-user statistics kept by signed deltas.

Counts and sums take a changed row's old contribution away and add its new
one. Maxima and distinct counts cannot be taken back that way; they come from a table
of value counts: (user, kind, slot, value) and how many of the user's rows hold
the value. A slot is a day of ``created_at`` or ``updated_at``, or one of
``PROJECT_SLOTS`` hash parts of the projects. Every slot has one ``peaks`` row
with its number of different values and its greatest one, so a user's maximum or
distinct count is an aggregate of the user's slots, never of the user's rows.

A batch reads and writes the buckets of the changed users (totals, peaks, statistics)
and of the changed slots (values). A busy user's slots lie in all buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import micros_between
from tidemark.operators.analytics import DAY, user_statistics
from tidemark.streaming.buckets import BucketStore

PROJECT_SLOTS = 64
SLOT = ("user_id", "kind", "slot")
VALUE = (*SLOT, "project_id", "at")
TOTALS = ["total_tasks", "completed_tasks", "ai_enhanced_tasks", "timed_tasks", "micros"]
KEYS = {"totals": "user_id", "values": SLOT, "peaks": "user_id", "statistics": "user_id"}


def _total_deltas(signed: DataFrame) -> DataFrame:
    """(user_id, TOTALS) of rows with a ``sign``."""
    done = F.col("archived") == F.lit(True)
    took = F.when(done, micros_between("created_at", "updated_at"))
    add = lambda when: F.sum(F.when(when, F.col("sign")).otherwise(F.lit(0).cast("long")))
    return signed.groupBy("user_id").agg(
        F.sum("sign").alias("total_tasks"), add(done).alias("completed_tasks"),
        add(F.col("ai_enhanced") == F.lit(True)).alias("ai_enhanced_tasks"), add(took.isNotNull()).alias("timed_tasks"),
        F.sum(F.coalesce(took * F.col("sign"), F.lit(0).cast("long"))).alias("micros"))


def _value_deltas(signed: DataFrame) -> DataFrame:
    """(VALUE, n) of rows with a ``sign``: the values whose counts change."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    none = F.lit(None)

    def entry(kind: str, slot: Column, project: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), slot.alias("slot"), project.cast("string").alias("project_id"),
                        at.cast("timestamp_ntz").alias("at"))
    done = F.when(F.col("archived") == F.lit(True), F.col("updated_at"))
    entries = F.array(
        entry("project", F.pmod(F.xxhash64("project_id"), F.lit(PROJECT_SLOTS)).cast("long"), F.col("project_id"), none),
        entry("created", day(F.col("created_at")), none, F.col("created_at")),
        entry("completed", day(done), none, done))
    return (signed.select("user_id", "sign", F.explode(entries).alias("e")).select("user_id", "sign", "e.*")
            .where("project_id is not null or at is not null")
            .groupBy(*VALUE).agg(F.sum("sign").alias("n")).where("n <> 0"))


def _peaks(values: DataFrame, *more: Column) -> DataFrame:
    """(SLOT, n_values, top) of value counts; slots without a value left have n_values 0."""
    held = F.col("n") > 0
    return values.groupBy(*SLOT).agg(F.count_if(held).alias("n_values"), F.max(F.when(held, F.col("at"))).alias("top"), *more)


def _statistics(totals: DataFrame, peaks: DataFrame) -> DataFrame:
    """The statistics rows of whole users, in the columns of user_statistics()."""
    kind = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    both = totals.unionByName(peaks, allowMissingColumns=True)  # a union takes users without an id along; a join would not
    s = both.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in TOTALS],
        F.coalesce(F.sum(kind("project", "n_values")), F.lit(0).cast("long")).alias("active_projects"),
        F.max(kind("created", "top")).alias("last_task_created"), F.max(kind("completed", "top")).alias("last_task_completed"))
    days = F.when(F.col("timed_tasks") > 0, F.col("micros").cast("double") / (F.col("timed_tasks") * F.lit(DAY * 1e6)))
    return s.select("user_id", "total_tasks", "completed_tasks", "ai_enhanced_tasks", "active_projects",
                    days.alias("avg_completion_days"), "last_task_created", "last_task_completed")


def start_tables(tasks: DataFrame) -> dict[str, DataFrame]:
    """The tables of KEYS for ``tasks`` as they are."""
    signed = tasks.withColumn("sign", F.lit(1).cast("long"))
    values = _value_deltas(signed)
    return {"totals": _total_deltas(signed), "values": values, "peaks": _peaks(values), "statistics": user_statistics(tasks)}


def apply_deltas(store: BucketStore, schemas: dict, before: DataFrame, after: DataFrame) -> dict:
    """Buckets of the tables of KEYS when the rows ``before`` become the rows ``after``, as BucketStore.write() takes them.

    ``before`` and ``after`` are all rows of the changed tasks (none for a task that is new, or gone). Rows that stay
    equal cancel out. Null users are one user, null projects and times are no values, equal rows count each.
    """
    cols = ["user_id", "project_id", "archived", "ai_enhanced", "created_at", "updated_at"]
    parts = [df.select(*cols, F.lit(s).cast("long").alias("sign")) for df, s in ((before, -1), (after, 1))]
    changed = reduce(DataFrame.unionByName, parts).checkpoint()  # read four times
    by_user = store.of(changed, "user_id")
    held = store.read("totals", schemas["totals"], by_user).unionByName(_total_deltas(changed))
    totals = held.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in TOTALS]).where("total_tasks > 0").checkpoint()

    moved = _value_deltas(changed).checkpoint()
    by_slot = store.of(moved, SLOT)
    values = (store.read("values", schemas["values"], by_slot).withColumn("moved", F.lit(False))
              .unionByName(moved.withColumn("moved", F.lit(True)))
              .groupBy(*VALUE).agg(F.sum("n").alias("n"), F.max("moved").alias("moved")).checkpoint())
    # only slots with a moved value send their new peak on to the users
    fresh = _peaks(values, F.max("moved").alias("moved")).where("moved").drop("moved")
    newest = F.max_by(F.struct("n_values", "top"), "age")
    peaks = (store.read("peaks", schemas["peaks"], by_user).withColumn("age", F.lit(0))
             .unionByName(fresh.withColumn("age", F.lit(1)))
             .groupBy(*SLOT).agg(newest.alias("p")).select(*SLOT, "p.*").where("n_values > 0").checkpoint())
    return {"totals": (totals, by_user), "values": (values.where("n > 0").drop("moved"), by_slot),
            "peaks": (peaks, by_user), "statistics": (_statistics(totals, peaks), by_user)}
