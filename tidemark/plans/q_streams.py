"""Registered streaming and stateful jobs (A12, J6-J8); each runs to completion
with an availableNow trigger and returns what its sink holds."""

from __future__ import annotations

from tidemark.plans.oracle_views import with_views
from tidemark.plans.q_search import SEARCH_CTES
from tidemark.plans.q_writes import FEED_SQL, MOMENT_NOTIFY_SQL, MOMENT_SUBSCRIBER_SQL, NOTIFY_SQL, SUBSCRIBER_SQL
from tidemark.plans.registry import register
from tidemark.sources.tables import dealt, load_views, read_table
from tidemark.streaming import feeds as FD

TTL_SQL = """with recursive ev as (
  select event_id, event_type as key, ts,
         row_number() over (partition by event_type order by ts, event_id) as rn from events),
fold(key, rn, event_id, miss_ts, is_miss) as (
  select key, rn, event_id, ts, true from ev where rn = 1
  union all
  select e.key, e.rn, e.event_id,
         case when e.ts >= f.miss_ts + interval 5 minute then e.ts else f.miss_ts end,
         e.ts >= f.miss_ts + interval 5 minute
  from fold f join ev e on e.key = f.key and e.rn = f.rn + 1)
select event_id, key, is_miss from fold"""


@register("ttl_dedup", TTL_SQL)
def q_ttl_dedup(spark, sf):
    return FD.ttl_dedup(read_table(spark, sf, "events"), "event_type")


@register("ttl_dedup_stream", TTL_SQL)
def q_ttl_dedup_stream(spark, sf):
    return FD.ttl_dedup_streaming_run(spark, sf, "event_type")


FINAL_CTES = [
    FEED_SQL,
    """lastupd as (select task_id, archived, ts from (
        select *, row_number() over (partition by task_id order by ts desc, event_id desc) as rn
        from feed where operation = 'UPDATE') x where rn = 1)""",
    # inserts name stored ids only, which stay as they are
    """gone as (select task_id from (
        select *, row_number() over (partition by task_id order by ts desc, event_id desc) as rn
        from feed) x where rn = 1 and operation = 'DELETE')""",
    """final as (select t.* replace (coalesce(l.archived, t.archived) as archived,
                                    coalesce(l.ts, t.updated_at) as updated_at)
        from tasks t left join lastupd l on l.task_id = t.id
        where t.id not in (select task_id from gone))""",
]


@register("live_task_list", with_views("""
select id, task, priority, archived, user_id, updated_at from final where archived = false and priority = 'high'""",
    *FINAL_CTES))
def q_live_task_list(spark, sf):
    t, _ = load_views(spark, sf)
    out = FD.scratch_path(spark, "live-list")
    return FD.live_task_list(spark, sf, t, out, archived=False, priority="high").select(
        "id", "task", "priority", "archived", "user_id", "updated_at")


@register("search_vector_stream", with_views("""
select user_id, id, lexeme, array_to_string(list_sort(list(pos)), ',') as positions
from toks where id not in (select task_id from gone) group by user_id, id, lexeme""", *SEARCH_CTES[:3], *FINAL_CTES))
def q_search_vector_stream(spark, sf):
    from pyspark.sql import functions as F
    t, _ = load_views(spark, sf)
    out = FD.scratch_path(spark, "postings")
    p = FD.search_vector_stream(spark, sf, dealt(t), out)
    return p.select("user_id", "id", "lexeme", F.array_join("positions", ",").alias("positions"))


@register("stream_user_statistics", with_views("""
select user_id, count(*) as total_tasks, count(*) filter (where archived) as completed_tasks,
       count(*) filter (where ai_enhanced) as ai_enhanced_tasks, count(distinct project_id) as active_projects,
       case when count(case when archived then 1 end) > 0 then
         cast(sum(case when archived then date_diff('microsecond', created_at, updated_at) end) as double)
         / (cast(count(case when archived then 1 end) as double) * 86400000000.0::double) end as avg_completion_days,
       max(created_at) as last_task_created, max(case when archived then updated_at end) as last_task_completed
from final group by user_id""", *FINAL_CTES))
def q_stream_user_statistics(spark, sf):
    t, _ = load_views(spark, sf)
    out = FD.scratch_path(spark, "stats")
    return FD.stream_user_statistics(spark, sf, t, out)


@register("change_notifications_stream", NOTIFY_SQL)
def q_change_notifications_stream(spark, sf):
    t, _ = load_views(spark, sf)
    return FD.notification_stream(spark, sf, t, FD.scratch_path(spark, "notify-out"))


@register("user_change_stream", SUBSCRIBER_SQL)
def q_user_change_stream(spark, sf):
    t, _ = load_views(spark, sf)
    return FD.subscription_stream(spark, sf, t, FD.scratch_path(spark, "subscriptions"))


@register("moment_notifications_stream", MOMENT_NOTIFY_SQL)
def q_moment_notifications_stream(spark, sf):
    """Several changes of each task: the old row is kept as state."""
    t, _ = load_views(spark, sf)
    return FD.notification_stream(spark, sf, t, FD.scratch_path(spark, "moment-out"), per_task=4)


@register("moment_subscribers_stream", MOMENT_SUBSCRIBER_SQL)
def q_moment_subscribers_stream(spark, sf):
    t, _ = load_views(spark, sf)
    return FD.subscription_stream(spark, sf, t, FD.scratch_path(spark, "moment-subscribers"), per_task=4)
