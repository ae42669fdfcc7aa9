"""Registered writes, overlays and change-feed effects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.rules import SYSTEM_PROMPT
from tidemark.operators import mutations as M
from tidemark.operators.lists import context_tasks
from tidemark.operators.textrules import task_context_text
from tidemark.plans.oracle_views import CONTEXT_SQL, SYSTEM_SQL, with_views
from tidemark.plans.registry import LIST_AS_OF, register
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.tables import load_views, read_table

NOW = f"timestamp '{LIST_AS_OF}'"
ALL = ("id, task, project_id, date, priority, archived, user_id, ai_enhanced, metadata, "
       "parent_task_id, created_at, updated_at")

FEED_SQL = """feed as (
  select event_id, cast(ts as timestamp) as ts,
         case when event_type = 'signup' then 'INSERT' when event_type = 'error' then 'DELETE'
              else 'UPDATE' end as operation,
         event_id + 1 as task_id, 'u' || cast(user_id % 20 as varchar) as user_id,
         event_type = 'purchase' as archived
  from events)"""


def _now():
    return F.expr(f"timestamp_ntz'{LIST_AS_OF}'")


@register("insert_tasks", with_views(f"""
select {ALL} from tasks
union all
select id + 1000000000, 'Copy of ' || task, coalesce(nullif(case when id % 20 = 0 then '' else project_id end, ''), '1'),
       nullif(date, ''), 'medium', false, user_id, false, '{{}}', null, {NOW}, {NOW}
from tasks"""))
def q_insert_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    i = F.col("id")
    new = t.select(
        (i + 1_000_000_000).alias("id"), F.concat(F.lit("Copy of "), F.col("task")).alias("task"),
        F.when(i % 20 == 0, F.lit("")).otherwise(F.col("project_id")).alias("project_id"), "date",
        F.lit(None).cast("string").alias("priority"), "user_id",
        F.lit(None).cast("boolean").alias("ai_enhanced"), F.lit(None).cast("string").alias("metadata"),
        F.lit(None).cast("long").alias("parent_task_id"))
    return M.insert_rows(t, new, as_of=LIST_AS_OF)


@register("insert_projects", with_views(f"""
select id, name, user_id, created_at, updated_at from projects
union all
select 'inbox-' || user_id, 'Inbox', user_id, {NOW}, {NOW} from (select distinct user_id from tasks) u"""))
def q_insert_projects(spark, sf):
    from tidemark.sources.tables import PROJECT_SCHEMA
    t, p = load_views(spark, sf)
    new = t.select("user_id").distinct().select(
        F.concat(F.lit("inbox-"), F.col("user_id")).alias("id"), F.lit("Inbox").alias("name"), "user_id")
    return M.insert_rows(p, new, as_of=LIST_AS_OF, schema=PROJECT_SCHEMA, defaults=False)


@register("patch_tasks", with_views(f"""
select t.id,
       case when t.id % 7 = 0 then upper(t.task) else t.task end as task,
       case when t.id % 21 = 0 then null else t.date end as date,
       case when t.id % 14 = 0 then 'high' else t.priority end as priority,
       case when t.id % 7 = 0 then {NOW} else t.updated_at end as updated_at
from tasks t"""))
def q_patch_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    i = F.col("id")
    patches = t.where(i % 7 == 0).select(
        "id", F.upper("task").alias("task"),
        F.lit(None).cast("string").alias("date"), (i % 21 == 0).alias("set_date"),
        F.lit("high").alias("priority"), (i % 14 == 0).alias("set_priority"))
    return M.patch_rows(t, patches, as_of=LIST_AS_OF).select("id", "task", "date", "priority", "updated_at")


@register("delete_cascade", "with recursive " + with_views("""
select id, parent_task_id from tasks where id not in (select id from gone)""",
    """gone(id) as (select id from tasks where id % 50 = 1
                   union select t.id from tasks t join gone g on t.parent_task_id = g.id)""")[len("with "):])
def q_delete_cascade(spark, sf):
    t, _ = load_views(spark, sf)
    return M.delete_cascade(t, t.where(F.col("id") % 50 == 1).select("id")).select("id", "parent_task_id")


@register("delete_projects", with_views("""
select id, name, user_id from projects where cast(id as int) % 5 <> 0"""))
def q_delete_projects(spark, sf):
    _, p = load_views(spark, sf)
    return M.delete_rows(p, p.where(F.col("id").cast("int") % 5 == 0).select("id")).select("id", "name", "user_id")


@register("versioned_update", with_views("""
select id, 'applied' as status, task || ' (edited)' as task from tasks where id % 3 in (0, 1)
union all
select id, 'conflict', task from tasks where id % 3 = 2"""))
def q_versioned_update(spark, sf):
    t, _ = load_views(spark, sf)
    i = F.col("id")
    patches = t.select(
        "id", F.concat(F.col("task"), F.lit(" (edited)")).alias("task"),
        F.when(i % 3 == 1, F.col("updated_at"))
         .when(i % 3 == 2, F.col("updated_at") - F.expr("interval 1 minute")).alias("expected_version"))
    table, conflicts = M.versioned_update(t, patches, as_of=LIST_AS_OF)
    applied = table.join(patches.select("id", "expected_version"), "id").join(conflicts.select("id"), "id", "left_anti")
    return (applied.select("id", F.lit("applied").alias("status"), "task")
            .unionByName(conflicts.join(t.select("id", "task"), "id").select("id", F.lit("conflict").alias("status"), "task")))


@register("bulk_subtasks", with_views(f"""
select t.id * 10 + s.pos as id, s.prefix || t.task as task, t.project_id, null::varchar as date,
       case when s.pos = 1 then 'low' else 'high' end as priority, false as archived, t.user_id,
       true as ai_enhanced,
       '{{"parentTask":' || to_json(t.task) || ',"type":"subtask","aiGenerated":true}}' as metadata,
       t.id as parent_task_id, {NOW} as created_at, {NOW} as updated_at
from tasks t, (values (1, 'Research: '), (2, 'Execute: ')) s(pos, prefix)"""))
def q_bulk_subtasks(spark, sf):
    t, _ = load_views(spark, sf)
    steps = F.array(F.struct(F.lit(1).alias("pos"), F.lit("Research: ").alias("prefix"), F.lit("").alias("prio")),
                    F.struct(F.lit(2).alias("pos"), F.lit("Execute: ").alias("prefix"), F.lit("high").alias("prio")))
    s = (t.select("id", "task", "project_id", "user_id", F.explode(steps).alias("s"))
         .select((F.col("id") * 10 + F.col("s.pos")).alias("id"),
                 F.concat(F.col("s.prefix"), F.col("task")).alias("task"), "project_id",
                 F.lit(None).cast("string").alias("date"), F.col("s.prio").alias("priority"), "user_id",
                 F.to_json(F.struct(F.col("task").alias("parentTask"), F.lit("subtask").alias("type"),
                                    F.lit(True).alias("aiGenerated"))).alias("metadata"),
                 F.col("id").alias("parent_task_id")))
    return M.bulk_subtasks(s, as_of=LIST_AS_OF)


OVERLAY_COLS = ["id", "task", "project_id", "priority", "archived", "user_id", "created_at", "updated_at"]


def _pending(t):
    """Pending operations with their order: two edits of a task (the later one sorts first as text),
    a priority change between them, archives, deletes and adds."""
    i = F.col("id")
    none = F.lit(None).cast("string")

    def ops(seq, op, rows, task=none, priority=none):
        return t.where(rows).select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "id", none.alias("temp_id"),
                                    task.alias("task"), priority.alias("priority"), "user_id")
    edits = (ops(1, "update", i % 83 == 0, F.concat(F.lit("zzz "), F.col("task")))
             .unionByName(ops(2, "update", i % 166 == 0, priority=F.lit("high")))
             .unionByName(ops(3, "update", i % 83 == 0, F.concat(F.lit("aaa "), F.col("task")))))
    adds = t.where(i % 101 == 0).select(
        F.lit(9).alias("seq"), F.lit("add").alias("op"), F.lit(None).cast("long").alias("id"),
        F.concat(F.lit("temp-"), (i * 1000).cast("string")).alias("temp_id"),
        F.concat(F.lit("Follow up: "), F.col("task")).alias("task"), none.alias("priority"), "user_id")
    return (edits.unionByName(ops(4, "archive", i % 89 == 0)).unionByName(ops(5, "delete", i % 97 == 0))
            .unionByName(adds))


OVERLAY_SQL = f"""overlay as (
  select null::bigint as id, 'temp-' || cast(id * 1000 as varchar) as temp_id, 'Follow up: ' || task as task,
         null::varchar as project_id, null::varchar as priority,
         false as archived, user_id, {NOW} as created_at, {NOW} as updated_at, true as _optimistic,
         0 as overlay_pos
  from tasks where id % 101 = 0
  union all
  select id, null, case when id % 83 = 0 then 'aaa ' || task else task end, project_id,
         case when id % 166 = 0 then 'high' else priority end,
         archived or (id % 89 = 0), user_id, created_at,
         case when id % 83 = 0 then {NOW} else updated_at end,
         id % 89 = 0 or id % 83 = 0, 1
  from tasks where id % 97 <> 0)"""


def _overlay(t):
    return M.pending_overlay(t.select(*OVERLAY_COLS), _pending(t), as_of=LIST_AS_OF)


@register("pending_overlay", with_views("""
select *, case when archived then 'archived' else 'active' end as list from overlay""", OVERLAY_SQL))
def q_pending_overlay(spark, sf):
    t, _ = load_views(spark, sf)
    return _overlay(t).drop("_before")


@register("confirm_overlay", with_views("""
select id, temp_id, task, project_id, priority, archived, user_id, created_at, updated_at, _optimistic, overlay_pos,
       case when archived then 'archived' else 'active' end as list
from (
  select coalesce(o.id, cast(substr(o.temp_id, 6) as bigint) // 1000 + 2000000000) as id,
         null::varchar as temp_id, task, project_id, priority, archived, user_id, created_at, updated_at,
         false as _optimistic, overlay_pos
  from overlay o
  where (o.temp_id is null or cast(substr(o.temp_id, 6) as bigint) % 2000 = 0) and (o.id is null or o.id % 4 <> 1)
  union all
  select id, null, task, project_id, priority, archived, user_id, created_at, updated_at, false, 1
  from tasks where id % 4 = 1) x""", OVERLAY_SQL))
def q_confirm_overlay(spark, sf):
    t, _ = load_views(spark, sf)
    ov = _overlay(t)
    tid = F.substring("temp_id", 6, 40).cast("long")
    results = (ov.where(F.col("temp_id").isNotNull() & (tid % 2000 == 0))
               .select("temp_id", (tid / 1000 + 2_000_000_000).cast("long").alias("stored_id")))
    failed = _pending(t).where("op <> 'add' and id % 4 = 1").select("id")
    return M.confirm_overlay(ov, results, t.select(*OVERLAY_COLS), failed)


# The fixture's conversation N belongs to user u(N % 20).
@register("prepend_system_message", with_views(f"""
select conv_id, turn, role, text from conversations
union all
select c.conv_id, -1, 'system', {SYSTEM_SQL} || coalesce(x.context_text, '')
from (select distinct conv_id from conversations) c
left join ({CONTEXT_SQL}) x on x.user_id = 'u' || cast(c.conv_id % 20 as varchar)"""))
def q_prepend_system_message(spark, sf):
    t, _ = load_views(spark, sf)
    conv = read_table(spark, sf, "conversations")
    context = task_context_text(context_tasks(t, n=20)).select("user_id", "context_text")
    owner = F.concat(F.lit("u"), (F.col("conv_id") % 20).cast("string"))
    firsts = conv.select("conv_id").distinct().join(context, owner == F.col("user_id"), "left")
    return M.with_context_message(
        conv, firsts, F.concat(F.lit(SYSTEM_PROMPT), F.coalesce("context_text", F.lit(""))))


@register("change_feed", "with " + FEED_SQL + " select * from feed")
def q_change_feed(spark, sf):
    return M.change_feed_from_events(read_table(spark, sf, "events"))


@register("touch_updated_at", with_views("""
select t.id, coalesce(l.last_ts, t.updated_at) as updated_at
from tasks t left join (select task_id, max(ts) as last_ts from feed where operation = 'UPDATE' group by task_id) l
  on l.task_id = t.id""", FEED_SQL))
def q_touch_updated_at(spark, sf):
    t, _ = load_views(spark, sf)
    feed = M.change_feed_from_events(read_table(spark, sf, "events"))
    return M.touch_updated_at(t, feed).select("id", "updated_at")


CASCADE_SQL = "with recursive " + with_views(f"""
select t.id, case when w.id is not null then w.state else t.archived end as archived,
       case when w.id is not null then {NOW} else t.updated_at end as updated_at
from tasks t left join (select id, state from walk) w on w.id = t.id""",
    FEED_SQL,
    """changes as (select id, new_state from (
        select task_id as id, archived as new_state,
               row_number() over (partition by task_id order by ts desc, event_id desc) as rn
        from feed where operation = 'UPDATE') x where rn = 1 and id in (select id from tasks))""",
    """walk(id, state, flips) as (
        select c.id, c.new_state, c.new_state <> t.archived from changes c join tasks t on t.id = c.id
        union
        select t.id, w.state, true from walk w join tasks t on t.parent_task_id = w.id
        where w.flips and t.archived <> w.state and t.id not in (select id from changes))""")[len("with "):]


@register("archive_cascade", CASCADE_SQL)
def q_archive_cascade(spark, sf):
    t, _ = load_views(spark, sf)
    feed = M.change_feed_from_events(read_table(spark, sf, "events"))
    changes = M.latest_updates(feed).select("id", "new_state")
    return M.archive_cascade(t, changes, as_of=LIST_AS_OF).select("id", "archived", "updated_at")


@register("touch_projects", with_views("""
select p.id, coalesce(h.touched, p.updated_at) as updated_at
from projects p left join (select t.project_id, max(f.ts) as touched from feed f join tasks t on t.id = f.task_id
                           group by t.project_id) h on h.project_id = p.id""", FEED_SQL))
def q_touch_projects(spark, sf):
    t, p = load_views(spark, sf)
    feed = M.change_feed_from_events(read_table(spark, sf, "events"))
    return M.touch_projects(p, t, feed).select("id", "updated_at")


NOTIFY_SQL = with_views("""
select f.event_id, json_object('operation', f.operation,
        'user_id', coalesce(case when f.operation <> 'DELETE' then f.user_id end, t.user_id),
        'task_id', f.task_id, 'task_name', t.task,
        'timestamp', strftime(f.ts, '%Y-%m-%dT%H:%M:%S.%f'))::varchar as payload
from feed f left join tasks t on t.id = f.task_id""", FEED_SQL)


@register("change_notifications", NOTIFY_SQL)
def q_change_notifications(spark, sf):
    t, _ = load_views(spark, sf)
    feed = M.change_feed_from_events(read_table(spark, sf, "events"))
    return M.change_notifications(feed, t)


SUBSCRIBER_SQL = with_views("""
select distinct subscriber, event_id, operation, task_id from (
  select case when f.operation <> 'DELETE' then f.user_id end as subscriber, f.event_id, f.operation, f.task_id
  from feed f
  union all
  select t.user_id, f.event_id, f.operation, f.task_id from feed f join tasks t on t.id = f.task_id) x
where subscriber is not null""", FEED_SQL)


@register("user_change_feed", SUBSCRIBER_SQL + " and subscriber = 'u7'")
def q_user_change_feed(spark, sf):
    t, _ = load_views(spark, sf)
    feed = M.change_feed_from_events(read_table(spark, sf, "events"))
    return M.user_change_stream(feed, t, user="u7")


# several changes of one task: OLD is what the change before left, and a deleted task's text is gone
MOMENT_CTES = [
    FEED_SQL.replace("event_id + 1 as task_id", "event_id // 4 + 1 as task_id"),
    """moment as (
  select f.*, case when prev is null then t.user_id when prev <> 'DELETE' then prev_user end as old_user,
         case when deleted = 0 then t.task end as old_task
  from (select *, lag(operation) over w as prev, lag(user_id) over w as prev_user,
               count(case when operation = 'DELETE' then 1 end) over (w rows between unbounded preceding and 1 preceding) as deleted
        from feed window w as (partition by task_id order by ts, event_id)) f
  left join tasks t on t.id = f.task_id)"""]
MOMENT_NOTIFY_SQL = with_views("""
select event_id, json_object('operation', operation,
        'user_id', coalesce(case when operation <> 'DELETE' then user_id end, old_user),
        'task_id', task_id, 'task_name', old_task,
        'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'))::varchar as payload
from moment""", *MOMENT_CTES)
MOMENT_SUBSCRIBER_SQL = with_views("""
select distinct subscriber, event_id, operation, task_id from (
  select case when operation <> 'DELETE' then user_id end as subscriber, event_id, operation, task_id from moment
  union all
  select old_user, event_id, operation, task_id from moment) x
where subscriber is not null""", *MOMENT_CTES)


@register("moment_notifications", MOMENT_NOTIFY_SQL)
def q_moment_notifications(spark, sf):
    t, _ = load_views(spark, sf)
    return M.change_notifications(M.change_feed_from_events(read_table(spark, sf, "events"), 4), t)


@register("moment_subscribers", MOMENT_SUBSCRIBER_SQL)
def q_moment_subscribers(spark, sf):
    t, _ = load_views(spark, sf)
    return M.user_change_stream(M.change_feed_from_events(read_table(spark, sf, "events"), 4), t)


@register("mv_user_statistics", with_views("""
select user_id, count(*) as total_tasks, count(*) filter (where archived) as completed_tasks,
       count(*) filter (where ai_enhanced) as ai_enhanced_tasks, count(distinct project_id) as active_projects,
       case when count(case when archived then 1 end) > 0 then
         cast(sum(case when archived then date_diff('microsecond', created_at, updated_at) end) as double)
         / (cast(count(case when archived then 1 end) as double) * 86400000000.0::double) end as avg_completion_days,
       max(created_at) as last_task_created, max(case when archived then updated_at end) as last_task_completed
from tasks group by user_id"""))
def q_mv_user_statistics(spark, sf):
    from tidemark.streaming.feeds import refresh_user_statistics
    t, _ = load_views(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/user_statistics-{uuid.uuid4().hex}"
    return refresh_user_statistics(t, path)
