"""Registered analytics queries (D1-D19, E1, E2) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.plans.oracle_views import with_views
from tidemark.plans.registry import REPORT_AS_OF, register
from tidemark.sources.tables import load_views

NOW = f"timestamp '{REPORT_AS_OF}'"
SECS = "date_diff('microsecond', created_at, updated_at)"


def pct_sql(num: str, den: str, zero: bool = True) -> str:
    other = "cast(0 as decimal(10,2))" if zero else "cast(null as decimal(10,2))"
    return (f"case when {den} > 0 then cast(round(cast({num} * 100.0 / {den} as decimal(18,8)), 2)"
            f" as decimal(10,2)) else {other} end")


def avg_sql(x: str, unit: float) -> str:
    return (f"case when count({x}) > 0 then cast(sum({x}) as double) / "
            f"(cast(count({x}) as double) * {unit}::double) end")


ARCH_SECS = f"case when archived then {SECS} end"


def _views(spark, sf):
    return load_views(spark, sf)


@register("user_totals", with_views("""
select user_id, count(*) as total_tasks,
       count(*) filter (where archived) as completed_tasks,
       count(*) filter (where ai_enhanced) as ai_enhanced_count
from tasks group by user_id"""))
def q_user_totals(spark, sf):
    t, _ = _views(spark, sf)
    return A.user_totals(t)


_SCALARS = f"""
select user_id, total_tasks, completed_tasks,
       {pct_sql('completed_tasks', 'total_tasks')} as completion_rate,
       {pct_sql('ai_n', 'total_tasks')} as ai_enhanced_percentage,
       average_completion_time_days
from (select user_id, count(*) as total_tasks,
             count(*) filter (where archived) as completed_tasks,
             count(*) filter (where ai_enhanced) as ai_n,
             {avg_sql(ARCH_SECS, 86400000000.0)} as average_completion_time_days
      from tasks group by user_id) s"""


@register("user_analytics", with_views(_SCALARS))
def q_user_analytics(spark, sf):
    t, _ = _views(spark, sf)
    return A.user_analytics_scalars(t)


@register("user_rates", with_views(f"""
select user_id, completion_rate, ai_enhanced_percentage from ({_SCALARS}) x"""))
def q_user_rates(spark, sf):
    t, _ = _views(spark, sf)
    return A.user_rates(t)


@register("user_rates_int", with_views("""
select user_id, total_tasks, completed_tasks,
       case when total_tasks > 0 then cast(floor(cast(completed_tasks as double) / total_tasks * 100.0 + 0.5) as bigint) else 0 end as completion_rate,
       case when total_tasks > 0 then cast(floor(cast(ai_n as double) / total_tasks * 100.0 + 0.5) as bigint) else 0 end as ai_enhanced_percentage
from (select user_id, count(*) as total_tasks, count(*) filter (where archived) as completed_tasks,
             count(*) filter (where ai_enhanced) as ai_n from tasks group by user_id) s"""))
def q_user_rates_int(spark, sf):
    t, _ = _views(spark, sf)
    return A.user_rates_int(t)


@register("tasks_by_priority", with_views("""
select user_id, priority, count(*) as task_count
from tasks where priority is not null group by user_id, priority"""))
def q_tasks_by_priority(spark, sf):
    t, _ = _views(spark, sf)
    return A.tasks_by_priority(t)


@register("tasks_by_project", with_views("""
select t.user_id, coalesce(p.name, 'Unknown Project') as project_name, count(*) as task_count
from tasks t left join projects p on t.project_id = p.id
group by t.user_id, coalesce(p.name, 'Unknown Project')"""))
def q_tasks_by_project(spark, sf):
    t, p = _views(spark, sf)
    return A.tasks_by_project(t, p)


@register("avg_completion_days", with_views(f"""
select user_id, {avg_sql(ARCH_SECS, 86400000000.0)} as average_completion_time_days
from tasks group by user_id"""))
def q_avg_completion_days(spark, sf):
    t, _ = _views(spark, sf)
    return A.avg_completion_days(t)


@register("productivity_trend", with_views(f"""
select user_id, cast(created_at as date) as date,
       count(*) filter (where archived) as completed, count(*) as created
from tasks where created_at >= {NOW} - interval 30 day
group by user_id, cast(created_at as date)"""))
def q_productivity_trend(spark, sf):
    t, _ = _views(spark, sf)
    return A.productivity_trend(t, as_of=REPORT_AS_OF)


@register("daily_completions", with_views(f"""
select user_id, cast(updated_at as date) as date, count(*) as completed,
       {avg_sql(SECS, 3600000000.0)} as avg_completion_time_hours,
       count(*) filter (where ai_enhanced) as ai_enhanced_completed
from tasks where archived and updated_at >= {NOW} - interval 30 day
group by user_id, cast(updated_at as date)"""))
def q_daily_completions(spark, sf):
    t, _ = _views(spark, sf)
    return A.daily_completions(t, as_of=REPORT_AS_OF)


_PERF = f"""
select t.user_id, {{name}} as project_name,
       {pct_sql('count(*) filter (where t.archived)', 'count(*)', zero=False)} as completion_rate,
       {avg_sql("case when t.archived then date_diff('microsecond', t.created_at, t.updated_at) end", 3600000000.0)}
         as avg_completion_time
from tasks t left join projects p on t.project_id = p.id
where t.created_at >= {NOW} - interval 30 day
group by t.user_id, {{name}}"""


@register("project_performance",
          with_views(_PERF.format(name="coalesce(p.name, 'Unknown Project')")))
def q_project_performance(spark, sf):
    t, p = _views(spark, sf)
    return A.project_performance(t, p, as_of=REPORT_AS_OF)


@register("distinct_projects_perf",
          with_views("select distinct * from (" + _PERF.format(name="p.name") + ") d"))
def q_distinct_projects_perf(spark, sf):
    t, p = _views(spark, sf)
    return A.distinct_projects_perf(t, p, as_of=REPORT_AS_OF)


def _mode_sql(value: str, where: str, out: str) -> str:
    return f"""(select user_id, {out} from (
      select user_id, v as {out}, row_number() over (partition by user_id order by count(*) desc, v) as rn
      from (select user_id, {value} as v from tasks where {where}) m
      group by user_id, v) r where rn = 1)"""


_WIN = f"archived and updated_at >= {NOW} - interval 30 day"
_INSIGHTS = f"""
select u.user_id, cast(d.peak_productivity_day as int) as peak_productivity_day,
       cast(h.peak_productivity_hour as int) as peak_productivity_hour,
       u.completion_velocity, u.ai_task_success_rate
from (select user_id,
        case when count(*) filter (where archived) > 7 then
          cast(round(cast((count(*) filter (where archived and updated_at >= {NOW} - interval 7 day)
                 - count(*) filter (where archived and updated_at >= {NOW} - interval 14 day
                                     and updated_at < {NOW} - interval 7 day)) / 7.0 as decimal(18,8)), 2)
               as decimal(10,2))
        else cast(0 as decimal(10,2)) end as completion_velocity,
        {pct_sql(f"count(*) filter (where ai_enhanced and archived and created_at >= {NOW} - interval 30 day)",
                 f"count(*) filter (where ai_enhanced and created_at >= {NOW} - interval 30 day)")}
          as ai_task_success_rate
      from tasks group by user_id) u
left join {_mode_sql('dayofweek(updated_at)', _WIN, 'peak_productivity_day')} d on d.user_id = u.user_id
left join {_mode_sql('hour(updated_at)', _WIN, 'peak_productivity_hour')} h on h.user_id = u.user_id"""


@register("productivity_insights", with_views(_INSIGHTS))
def q_productivity_insights(spark, sf):
    t, p = _views(spark, sf)
    return A.insight_scalars(t, as_of=REPORT_AS_OF)


@register("peak_day", with_views(f"select user_id, peak_productivity_day from ({_INSIGHTS}) x"))
def q_peak_day(spark, sf):
    t, _ = _views(spark, sf)
    return A.peak_day(t, as_of=REPORT_AS_OF)


@register("peak_hour", with_views(f"select user_id, peak_productivity_hour from ({_INSIGHTS}) x"))
def q_peak_hour(spark, sf):
    t, _ = _views(spark, sf)
    return A.peak_hour(t, as_of=REPORT_AS_OF)


@register("completion_velocity", with_views(f"select user_id, completion_velocity from ({_INSIGHTS}) x"))
def q_completion_velocity(spark, sf):
    t, _ = _views(spark, sf)
    return A.completion_velocity(t, as_of=REPORT_AS_OF)


@register("ai_success_rate", with_views(f"select user_id, ai_task_success_rate from ({_INSIGHTS}) x"))
def q_ai_success_rate(spark, sf):
    t, _ = _views(spark, sf)
    return A.ai_success_rate(t, as_of=REPORT_AS_OF)


_SCOPE = f"created_at >= {NOW} - interval 30 day"


@register("insights_single_scope", with_views(f"""
select u.user_id, cast(d.peak_productivity_day as int) as peak_productivity_day,
       cast(h.peak_productivity_hour as int) as peak_productivity_hour,
       u.completion_velocity, u.ai_task_success_rate
from (select user_id,
        case when count(*) > 7 then
          cast(round(cast((count(*) filter (where updated_at >= {NOW} - interval 7 day)
                 - count(*) filter (where updated_at >= {NOW} - interval 14 day
                                     and updated_at < {NOW} - interval 7 day)) / 7.0 as decimal(18,8)), 2)
               as decimal(10,2))
        else cast(0 as decimal(10,2)) end as completion_velocity,
        {pct_sql("count(*) filter (where ai_enhanced and archived)", "count(*) filter (where ai_enhanced)")}
          as ai_task_success_rate
      from tasks where {_SCOPE} group by user_id) u
left join {_mode_sql('dayofweek(updated_at)', _SCOPE, 'peak_productivity_day')} d on d.user_id = u.user_id
left join {_mode_sql('hour(updated_at)', _SCOPE, 'peak_productivity_hour')} h on h.user_id = u.user_id"""))
def q_insights_single_scope(spark, sf):
    t, _ = _views(spark, sf)
    return A.insights_single_scope(t, as_of=REPORT_AS_OF)


@register("user_statistics", with_views(f"""
select user_id, count(*) as total_tasks,
       count(*) filter (where archived) as completed_tasks,
       count(*) filter (where ai_enhanced) as ai_enhanced_tasks,
       count(distinct project_id) as active_projects,
       {avg_sql(ARCH_SECS, 86400000000.0)} as avg_completion_days,
       max(created_at) as last_task_created,
       max(case when archived then updated_at end) as last_task_completed
from tasks group by user_id"""))
def q_user_statistics(spark, sf):
    t, _ = _views(spark, sf)
    return A.user_statistics(t)


@register("productivity_analytics", with_views(f"""
select g.*, m.most_common_priority from (
  select user_id, cast(created_at as date) as date, count(*) as tasks_created,
         count(*) filter (where archived) as tasks_completed,
         count(*) filter (where ai_enhanced) as ai_tasks_created,
         count(*) filter (where ai_enhanced and archived) as ai_tasks_completed,
         {avg_sql(ARCH_SECS, 3600000000.0)} as avg_completion_hours
  from tasks where created_at >= {NOW} - interval 90 day
  group by user_id, cast(created_at as date)) g
left join (
  select user_id, date, priority as most_common_priority from (
    select user_id, cast(created_at as date) as date, priority,
           row_number() over (partition by user_id, cast(created_at as date)
                              order by (priority is null), count(*) desc, priority) as rn
    from tasks where created_at >= {NOW} - interval 90 day
    group by user_id, cast(created_at as date), priority) r
  where rn = 1) m on m.user_id = g.user_id and m.date = g.date"""))
def q_productivity_analytics(spark, sf):
    t, _ = _views(spark, sf)
    return A.productivity_analytics(t, as_of=REPORT_AS_OF)


@register("project_task_counts", with_views("""
select p.id, p.name, p.user_id, p.created_at, p.updated_at, coalesce(c.n, 0) as task_count
from projects p left join (select project_id, count(*) as n from tasks group by project_id) c
  on c.project_id = p.id"""))
def q_project_task_counts(spark, sf):
    t, p = _views(spark, sf)
    return A.project_task_counts(p, t)


@register("priority_insights", with_views("""
select user_id, i.insight_no, i.insight from (select user_id, count(*) as n from tasks group by user_id) c,
  lateral (select 0 as insight_no, cast(c.n as varchar) || ' tasks analyzed for intelligent prioritization' as insight
           union all select 1, 'Consider tackling high-priority items during your peak energy hours'
           union all select 2, 'Group similar tasks together for better efficiency') i"""))
def q_priority_insights(spark, sf):
    t, _ = _views(spark, sf)
    return A.priority_insights(t)


@register("priority_window_count", with_views("""
select id, user_id, priority, count(*) over (partition by user_id, priority) as priority_count
from tasks"""))
def q_priority_window_count(spark, sf):
    t, _ = _views(spark, sf)
    return A.priority_window_count(t)


@register("project_window_count", with_views("""
select t.id, t.user_id, coalesce(p.name, 'Unknown Project') as project_name,
       count(*) over (partition by t.user_id, coalesce(p.name, 'Unknown Project')) as project_count
from tasks t left join projects p on t.project_id = p.id"""))
def q_project_window_count(spark, sf):
    t, p = _views(spark, sf)
    return A.project_window_count(t, p)


# The full records, one row per scalar set, map entry and listed day.
@register("user_analytics_record", with_views(f"""
select user_id, 'totals' as section, '' as entry, completed_tasks as completed, total_tasks as total,
       cast(completion_rate as double) as rate, cast(ai_enhanced_percentage as double) as ai_rate,
       average_completion_time_days as avg_time
from ({_SCALARS}) s
union all
select user_id, 'priority', priority, null, count(*), null, null, null from tasks
where priority is not null group by user_id, priority
union all
select t.user_id, 'project', coalesce(p.name, 'Unknown Project'), null, count(*), null, null, null
from tasks t left join projects p on t.project_id = p.id group by t.user_id, coalesce(p.name, 'Unknown Project')
union all
select user_id, 'day', strftime(created_at, '%Y-%m-%d'), count(*) filter (where archived), count(*), null, null, null
from tasks where created_at >= {NOW} - interval 30 day group by user_id, strftime(created_at, '%Y-%m-%d')"""))
def q_user_analytics_record(spark, sf):
    t, p = _views(spark, sf)
    rec = A.user_analytics(t, p, as_of=REPORT_AS_OF)
    none, no_n = F.lit(None).cast("double"), F.lit(None).cast("long")

    def row(section, entry, completed, total, rate=none, ai=none, avg=none):
        return F.struct(F.lit(section).alias("section"), entry.cast("string").alias("entry"),
                        completed.alias("completed"), total.alias("total"), rate.cast("double").alias("rate"),
                        ai.cast("double").alias("ai_rate"), avg.alias("avg_time"))
    totals = F.array(row("totals", F.lit(""), F.col("completed_tasks"), F.col("total_tasks"), F.col("completion_rate"),
                         F.col("ai_enhanced_percentage"), F.col("average_completion_time_days")))

    def entries(section):
        return F.transform(F.map_entries(f"tasks_by_{section}"), lambda e: row(section, e["key"], no_n, e["value"]))
    maps = [entries("priority"), entries("project")]
    days = F.transform("productivity_trend", lambda d: row("day", d["date"], d["completed"], d["created"]))
    return rec.select("user_id", F.inline(F.concat(totals, *maps, days)))


@register("productivity_insights_record", with_views(f"""
select user_id, 'scalars' as section, '' as entry, cast(peak_productivity_day as bigint) as n1,
       cast(peak_productivity_hour as bigint) as n2, cast(completion_velocity as double) as x1,
       cast(ai_task_success_rate as double) as x2
from ({_INSIGHTS}) s
union all
select user_id, 'day', strftime(updated_at, '%Y-%m-%d'), count(*), count(*) filter (where ai_enhanced),
       {avg_sql(SECS, 3600000000.0)}, null
from tasks where archived and updated_at >= {NOW} - interval 30 day
group by user_id, strftime(updated_at, '%Y-%m-%d')
union all
select user_id, 'project', project_name, null, null, cast(completion_rate as double), avg_completion_time
from ({_PERF.format(name="coalesce(p.name, 'Unknown Project')")}) q"""))
def q_productivity_insights_record(spark, sf):
    t, p = _views(spark, sf)
    rec = A.productivity_insights(t, p, as_of=REPORT_AS_OF)
    none, no_n = F.lit(None).cast("double"), F.lit(None).cast("long")

    def row(section, entry, n1=no_n, n2=no_n, x1=none, x2=none):
        return F.struct(F.lit(section).alias("section"), entry.cast("string").alias("entry"), n1.cast("long").alias("n1"),
                        n2.cast("long").alias("n2"), x1.cast("double").alias("x1"), x2.cast("double").alias("x2"))
    scalars = F.array(row("scalars", F.lit(""), F.col("peak_productivity_day"), F.col("peak_productivity_hour"),
                          F.col("completion_velocity"), F.col("ai_task_success_rate")))
    empty = F.array().cast("array<" + "struct<section:string,entry:string,n1:bigint,n2:bigint,x1:double,x2:double>>")
    days = F.transform("daily_completions", lambda d: row("day", d["date"], d["completed"], d["ai_enhanced_completed"],
                                                          d["avg_completion_time_hours"]))
    perf = F.transform("project_performance", lambda d: row("project", d["project_name"], x1=d["completion_rate"],
                                                            x2=d["avg_completion_time"]))
    return rec.select("user_id", F.inline(F.concat(scalars, F.coalesce(days, empty), F.coalesce(perf, empty))))
