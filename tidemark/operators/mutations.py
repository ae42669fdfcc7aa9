"""Set-based writes, cascades, overlays and change-feed effects
(A5-A8, A13, G1-G3, J1-J5).

The reference writes one row per request and lets triggers react per row;
here every write is a DataFrame of changes applied to a table in one job
(joins + unions), and each trigger becomes a set-based step over the change
frame. Results are new DataFrames; persisting them (overwrite to a new
directory, then swap) is the caller's sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import ts_lit
from tidemark.operators.hierarchy import descendants, state_cascade
from tidemark.operators.lists import apply_defaults, conform_schema
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.tables import TASK_SCHEMA

PATCHABLE = ["task", "project_id", "date", "priority", "archived", "ai_enhanced", "metadata",
             "parent_task_id"]


def insert_rows(base: DataFrame, new_rows: DataFrame, *, as_of=None, schema=TASK_SCHEMA,
                defaults: bool = True) -> DataFrame:
    """A5: append a batch (defaults applied, timestamps = as_of) and return the table.

    Rows without an ``id`` get the ids after the current maximum, in the order
    of their values: the ids depend on the batch alone, not on its
    partitions. Only the maximum (one scalar) reaches the driver.
    """
    rows = apply_defaults(new_rows) if defaults else new_rows
    if "id" not in rows.columns:
        top = base.agg(F.max("id")).first()[0] or 0
        rows = numbered(rows, int(top) + 1)
    rows = conform_schema(rows, schema, now=ts_lit(as_of))
    return conform_schema(base, schema).unionByName(rows)


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """Add ``id`` = ``first``, ``first`` + 1, ... in the order of all columns.

    Range partitions are written with their number, and each starts after the
    row counts of those before it, so no task sees more than its partition.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    order = list(rows.columns)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (placed.withColumn("_nth", nth).join(F.broadcast(starts), "_part")
            .withColumn("id", F.lit(first) + F.col("_start") + F.col("_nth") - 1).drop("_part", "_nth", "_start"))


def inserted_rows(new_rows: DataFrame, *, as_of=None, schema=TASK_SCHEMA) -> DataFrame:
    """A5 returning form: the stored rows of the batch (what ``.select()`` returns)."""
    return conform_schema(apply_defaults(new_rows), schema, now=ts_lit(as_of))


def patch_rows(base: DataFrame, patches: DataFrame, *, as_of=None, touch: bool = True) -> DataFrame:
    """A6 + J1: update by id, only the supplied fields; absent differs from NULL.

    ``patches`` has ``id`` and any subset of the patchable columns. A column
    ``set_<name>`` (boolean), when present, says per row whether that field
    was supplied; without it every row of the frame supplies the field.
    Matched rows get ``updated_at = as_of`` (the BEFORE UPDATE trigger).
    """
    fields = [c for c in PATCHABLE if c in patches.columns]
    p = patches.select(F.col("id").alias("_pid"),
                       *[F.col(c).alias("_new_" + c) for c in fields],
                       *[F.col("set_" + c).alias("_set_" + c) for c in fields
                         if "set_" + c in patches.columns],
                       F.lit(True).alias("_matched"))
    j = base.join(p, base["id"] == p["_pid"], "left")
    cols = []
    for c in base.columns:
        if c in fields:
            supplied = F.col("_matched") & (F.col("_set_" + c) if "set_" + c in patches.columns else F.lit(True))
            cols.append(F.when(F.coalesce(supplied, F.lit(False)), F.col("_new_" + c)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and touch:
            cols.append(F.when(F.col("_matched"), ts_lit(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def delete_cascade(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete ``ids`` and all their descendants (ON DELETE CASCADE)."""
    gone = descendants(tasks, ids).select("id")
    return tasks.join(gone, "id", "left_anti")


def delete_rows(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Plain delete by id (projects: their tasks stay and become orphans)."""
    return table.join(ids.select("id"), "id", "left_anti")


def versioned_update(base: DataFrame, patches: DataFrame, *, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Apply a patch only if ``expected_version`` is NULL or equals ``updated_at``.

    Returns (table after the applied patches, conflicts). A conflict row
    names the patch id, its expected version and the stored version.
    """
    cur = base.select(F.col("id").alias("_cid"), F.col("updated_at").alias("current_version"))
    checked = patches.join(cur, patches["id"] == cur["_cid"], "inner").drop("_cid")
    ok = F.col("expected_version").isNull() | (F.col("expected_version") == F.col("current_version"))
    applied = checked.where(ok).drop("expected_version", "current_version")
    conflicts = checked.where(~ok).select("id", "expected_version", "current_version")
    return patch_rows(base, applied, as_of=as_of), conflicts


def bulk_subtasks(subtasks: DataFrame, *, as_of=None) -> DataFrame:
    """Child rows under their parent: priority defaults to 'low', AI flag true."""
    s = subtasks.withColumn("priority", F.coalesce(F.nullif(F.col("priority"), F.lit("")), F.lit("low")))
    s = s.withColumn("ai_enhanced", F.lit(True))
    return inserted_rows(s, as_of=as_of)


# --------------------------------------------------------------------------
# G: optimistic overlays and chat messages
# --------------------------------------------------------------------------

OVERLAY_FIELDS = ["task", "project_id", "date", "priority", "archived", "ai_enhanced", "metadata", "parent_task_id"]


def pending_overlay(base: DataFrame, pending: DataFrame, *, as_of=None) -> DataFrame:
    """G1: the snapshot with pending operations overlaid, flagged ``_optimistic``.

    ``pending`` = (seq, op, id, temp_id, user_id and any fields of the table)
    with op in add / update / delete / archive; ``seq`` orders the operations.
    Adds come first (``overlay_pos`` 0) with a temporary id; an update merges
    the fields it gives (non-NULL), the last one in ``seq`` order per field,
    and touches updated_at; an archive sets ``archived``; a delete drops the
    row, whatever else is pending for it. ``list`` tells the active and
    archived lists apart. The row as stored rides along in ``_before``, so
    that confirm_overlay() can bring it back.
    """
    fields = [c for c in OVERLAY_FIELDS if c in base.columns and c in pending.columns]
    b = base.withColumn("_before", F.struct(*base.columns)).withColumn("temp_id", F.lit(None).cast("string"))
    ops = pending.where(F.col("op") != "add")
    is_upd = F.col("op") == "update"
    # the last value given per field: max_by skips no NULL value, so only rows that give one are ordered
    last = [F.max_by(c, F.when(is_upd & F.col(c).isNotNull(), F.col("seq"))).alias("_new_" + c) for c in fields]
    upd = ops.groupBy("id").agg(
        *last, F.max(is_upd).alias("_edited"), F.max(F.col("op") == "archive").alias("_arch"),
        F.max(F.col("op") == "delete").alias("_gone"), F.lit(True).alias("_touched"))
    no = F.lit(False)
    j = b.join(upd, "id", "left").where(~F.coalesce(F.col("_gone"), no))
    own = {c: F.coalesce(F.col("_new_" + c), F.col(c)) if c in fields else F.col(c) for c in base.columns}
    own["archived"] = own["archived"] | F.coalesce(F.col("_arch"), no)
    own["updated_at"] = F.when(F.coalesce(F.col("_edited"), no), ts_lit(as_of)).otherwise(F.col("updated_at"))
    merged = j.select(*[v.alias(c) for c, v in own.items()], "temp_id", "_before",
                      F.coalesce(F.col("_touched"), no).alias("_optimistic"), F.lit(1).alias("overlay_pos"))
    new = {c: F.col(c) if c in pending.columns else F.lit(None).cast(base.schema[c].dataType) for c in base.columns}
    new |= {"id": F.lit(None).cast(base.schema["id"].dataType), "archived": F.lit(False),
            "created_at": ts_lit(as_of), "updated_at": ts_lit(as_of)}
    adds = pending.where(F.col("op") == "add").select(
        *[v.alias(c) for c, v in new.items()], "temp_id",
        F.lit(None).cast(merged.schema["_before"].dataType).alias("_before"),
        F.lit(True).alias("_optimistic"), F.lit(0).alias("overlay_pos"))
    return _listed(adds.unionByName(merged))


def _listed(overlay: DataFrame) -> DataFrame:
    return overlay.withColumn("list", F.when(F.col("archived"), "archived").otherwise("active"))


def confirm_overlay(overlay: DataFrame, results: DataFrame, base: DataFrame | None = None,
                    failed: DataFrame | None = None) -> DataFrame:
    """Settle the overlay: stored ids for temporary ones, originals for what failed.

    ``results`` = (temp_id, stored_id); a temporary row without a stored id
    failed and is dropped. ``failed`` = (id) names the rows whose update,
    archive or delete failed: the row of ``base`` (the original list) comes
    back. All other rows keep the change and lose the flag.
    """
    # stored rows have no temporary id: a second part of the key, of their own id, deals them over the join's partitions
    deal = F.when(F.col("temp_id").isNull(), F.xxhash64("id")).otherwise(F.lit(0).cast("long"))
    r = (results.where(F.col("temp_id").isNotNull())
         .select(F.struct(F.col("temp_id").alias("tid"), F.lit(0).cast("long").alias("deal")).alias("_r_key"), "stored_id"))
    ov = overlay.withColumn("_key", F.struct(F.col("temp_id").alias("tid"), deal.alias("deal")))
    j = ov.join(r, ov["_key"] == r["_r_key"], "left")
    j = j.where(F.col("temp_id").isNull() | F.col("stored_id").isNotNull())
    out = (j.withColumn("id", F.coalesce(F.col("id"), F.col("stored_id")))
           .withColumn("temp_id", F.lit(None).cast("string"))
           .withColumn("_optimistic", F.lit(False)).drop("_key", "_r_key", "stored_id"))
    if failed is None:
        return out.drop("_before")
    bad = failed.select("id").distinct()
    fields = overlay.schema["_before"].dataType.names
    hit = F.col("_failed") & F.col("_before").isNotNull()
    out = out.join(bad.withColumn("_failed", F.lit(True)), "id", "left").withColumn(
        "_failed", F.coalesce("_failed", F.lit(False)))
    back = out.select(*[F.when(hit, F.col("_before")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
                        for c in out.columns if c not in ("_failed", "_before", "list")])
    # a failed delete has no row in the overlay: its original is read from the table
    # (ids take little room, so adaptive coalescing would join those of all rows into few tasks: dealt by number)
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lost = (base.join(bad, "id", "left_semi").join(out.select("id").repartition(n, "id"), "id", "left_anti")
            .withColumn("temp_id", F.lit(None).cast("string")).withColumn("_optimistic", F.lit(False))
            .withColumn("overlay_pos", F.lit(1)))
    return _listed(back.unionByName(lost))


def with_system_message(conv: DataFrame, text: Column | str, turn: int = -1) -> DataFrame:
    """A system message in front of each conversation's messages."""
    return with_context_message(conv, conv.select("conv_id").distinct(),
                                F.lit(text) if isinstance(text, str) else text, turn)


def with_context_message(conv: DataFrame, firsts: DataFrame, text: Column, turn: int = -1) -> DataFrame:
    """G3 with context: ``firsts`` has one row per conversation, ``text`` is an expression over it."""
    t = text
    sys_rows = firsts.select("conv_id", F.lit(turn).cast(conv.schema["turn"].dataType).alias("turn"),
                             F.lit("system").alias("role"), t.alias("text"))
    return sys_rows.unionByName(conv.select("conv_id", "turn", "role", "text"))


# --------------------------------------------------------------------------
# J: change-feed effects (batch form; the streaming jobs call these per batch)
# --------------------------------------------------------------------------

def change_feed_from_events(events: DataFrame, per_task: int = 1) -> DataFrame:
    """The task change feed derived from ``events`` (FIXTURES: events = change feed).

    signup -> INSERT, error -> DELETE, others -> UPDATE; task id = event_id + 1;
    a purchase archives the task, other updates un-archive it. With
    ``per_task`` > 1 so many neighbouring events are changes of one task.
    """
    op = (F.when(F.col("event_type") == "signup", "INSERT")
          .when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE"))
    return events.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), op.alias("operation"),
        (F.floor(F.col("event_id") / per_task) + 1).cast("long").alias("task_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_id"),
        (F.col("event_type") == "purchase").alias("archived"))


def touch_updated_at(tasks: DataFrame, feed: DataFrame) -> DataFrame:
    """Every updated row gets updated_at = time of its latest update."""
    last = (feed.where(F.col("operation") == "UPDATE").groupBy(F.col("task_id").alias("_tid"))
            .agg(F.max("ts").alias("_last")))
    j = tasks.join(last, tasks["id"] == last["_tid"], "left")
    return j.select(*[F.coalesce(F.col("_last"), F.col("updated_at")).alias("updated_at")
                      if c == "updated_at" else F.col(c) for c in tasks.columns])


def latest_updates(feed: DataFrame) -> DataFrame:
    """The last UPDATE per task (``max_by`` on the event time, event id breaks ties)."""
    u = feed.where(F.col("operation") == "UPDATE")
    last = F.max_by(F.struct("ts", "event_id", "archived"), F.struct("ts", "event_id"))
    return (u.groupBy("task_id").agg(last.alias("_l"))
            .select(F.col("task_id").alias("id"), F.col("_l.archived").alias("new_state"),
                    F.col("_l.ts").alias("ts")))


def archive_cascade(tasks: DataFrame, changes: DataFrame, *, as_of=None) -> DataFrame:
    """Archiving (un-archiving) a task does so for its descendants.

    ``changes`` = (id, new_state). Propagation passes only through rows
    whose state differs; every changed row gets ``updated_at = as_of``.
    Returns the whole table after the change.
    """
    changed = state_cascade(tasks, changes).select(F.col("id").alias("_cid"), "new_state")
    j = tasks.join(changed, tasks["id"] == changed["_cid"], "left")
    hit = F.col("_cid").isNotNull()
    return j.select(*[F.when(hit, F.col("new_state")).otherwise(F.col(c)).alias(c) if c == "archived"
                      else F.when(hit, ts_lit(as_of)).otherwise(F.col(c)).alias(c) if c == "updated_at"
                      else F.col(c) for c in tasks.columns])


def touch_projects(projects: DataFrame, tasks: DataFrame, feed: DataFrame) -> DataFrame:
    """Projects of changed tasks get updated_at = latest change time.

    INSERT/UPDATE touch the project of the new row, DELETE the one of the old
    row; the feed does not move tasks between projects, so both are the
    stored project of the task.
    """
    t = tasks.select(F.col("id").alias("task_id"), "project_id")
    hits = (feed.join(t, "task_id").groupBy(F.col("project_id").alias("_pid"))
            .agg(F.max("ts").alias("_touched")))
    j = projects.join(hits, projects["id"] == hits["_pid"], "left")
    return j.select(*[F.coalesce(F.col("_touched"), F.col(c)).alias(c) if c == "updated_at"
                      else F.col(c) for c in projects.columns])


TS_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def previous_rows(feed: DataFrame, tasks: DataFrame) -> DataFrame:
    """``feed`` with ``old_user`` and ``old_task``: the task's row before each change.

    The row before a change is what the change before it left: nothing after
    a DELETE, else its user, and the text last given; before a task's first change
    it is the row of ``tasks`` (of repeated ids the smallest row). Changes are ordered by (ts, event_id), or by
    the id alone if the feed has no time.
    """
    return rows_before(feed, stored_rows(tasks), [c for c in ("ts", "event_id") if c in feed.columns])


def stored_rows(tasks: DataFrame) -> DataFrame:
    """(task_id, user_id, task): one row for each id of ``tasks``, of repeated ids the smallest."""
    named = F.col("task") if "task" in tasks.columns else F.lit(None).cast("string")
    return (tasks.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("task_id"))
            .agg(F.min(F.struct("user_id", named.alias("task"))).alias("_row")).select("task_id", "_row.*"))


def rows_before(feed: DataFrame, stored: DataFrame, time: list[Column | str]) -> DataFrame:
    """``previous_rows`` over ``stored`` (task_id, user_id, task; one row a task) and changes in the order of ``time``.

    Changes are ordered in range partitions; a task's changes that lie in several partitions get what the
    partitions before theirs left from one small row per task and partition,
    so a busy task is many tasks' work.
    """
    spark = feed.sparkSession
    ensure_checkpoint_dir(spark)
    text = F.col("task") if "task" in feed.columns else F.lit(None).cast("string")
    gone = F.col("operation") == "DELETE"
    marked = feed.withColumns({
        "_user": F.struct(F.when(~gone, F.col("user_id")).alias("v")),
        "_text": F.when(gone, F.struct(F.lit(None).cast("string").alias("v")))
        .when(text.isNotNull(), F.struct(text.alias("v")))})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (marked.repartitionByRange(n, "task_id", *time)
              .withColumn("_part", F.spark_partition_id()).checkpoint())
    here = (Window.partitionBy("_part", "task_id").orderBy(*time)
            .rowsBetween(Window.unboundedPreceding, -1))
    order = F.struct(*time)
    left = placed.groupBy("task_id", "_part").agg(
        F.max_by("_user", order).alias("_user"),
        F.max_by("_text", F.when(F.col("_text").isNotNull(), order)).alias("_text"))
    earlier = Window.partitionBy("task_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select(F.col("task_id").alias("_left_id"), F.col("_part").alias("_left_part"),
                       F.last("_user", True).over(earlier).alias("_user_in"),
                       F.last("_text", True).over(earlier).alias("_text_in"))
    stored = stored.select(F.col("task_id").alias("_stored_id"), F.struct("user_id", "task").alias("_row"))
    rows = (placed.withColumns({"_user": F.last("_user", True).over(here), "_text": F.last("_text", True).over(here)})
            .join(left, F.col("task_id").eqNullSafe(F.col("_left_id")) & (F.col("_part") == F.col("_left_part")), "left")
            .join(stored, F.col("task_id").eqNullSafe(F.col("_stored_id")), "left"))

    def before(own: str, given: str, field: str) -> Column:
        return F.coalesce(F.col(own), F.col(given), F.struct(F.col(f"_row.{field}").alias("v")))["v"]
    return rows.select(*feed.columns, before("_user", "_user_in", "user_id").alias("old_user"),
                       before("_text", "_text_in", "task").alias("old_task"))


def notifications(rows: DataFrame) -> DataFrame:
    """A10/J4 payloads of changes that know the row before them (batch or stream)."""
    is_del = F.col("operation") == "DELETE"
    text = F.col("task") if "task" in rows.columns else F.lit(None).cast("string")
    payload = F.struct(
        F.col("operation").alias("operation"),
        F.coalesce(F.when(~is_del, F.col("user_id")), F.col("old_user")).alias("user_id"),
        F.col("task_id").alias("task_id"),
        F.coalesce(F.when(~is_del, text), F.col("old_task")).alias("task_name"),
        F.date_format("ts", TS_TEXT).alias("timestamp"))
    return rows.select("event_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def change_notifications(feed: DataFrame, tasks: DataFrame) -> DataFrame:
    """One JSON payload per change; NEW values, else OLD (deletes).

    OLD is the row at the moment of the change: the stored task, or what the
    changes before it made of it (see previous_rows). NEW has the feed's user
    and, if the feed gives one, its text.
    """
    return notifications(previous_rows(feed, tasks))


def subscribers(rows: DataFrame, either_side: bool = True, user: str | None = None) -> DataFrame:
    """A9/J5 deliveries of changes that know the row before them (batch or stream)."""
    new_user = F.when(F.col("operation") != "DELETE", F.col("user_id"))
    subs = F.array_distinct(F.array_compact(F.array(new_user, F.col("old_user")))) if either_side \
        else F.array_compact(F.array(new_user))
    out = rows.select(F.explode(subs).alias("subscriber"), "event_id", "operation", "task_id")
    return out if user is None else out.where(F.col("subscriber") == user)


def user_change_stream(feed: DataFrame, tasks: DataFrame, either_side: bool = True,
                       user: str | None = None) -> DataFrame:
    """Each change delivered to its subscribers.

    The fixed client listens on the new row's user; the older client also
    passes a change if the old row (at that moment) belongs to the user
    (``either_side``). ``user`` keeps one subscriber's changes.
    """
    return subscribers(previous_rows(feed, tasks), either_side, user)
