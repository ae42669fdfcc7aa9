"""Registered scan/list/join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import JS_WS, TRIM_RE
from tidemark.operators import analytics as A
from tidemark.operators import joins as J
from tidemark.operators import lists as L
from tidemark.plans.oracle_views import with_views
from tidemark.plans.registry import LIST_AS_OF, REPORT_AS_OF, register
from tidemark.sources.tables import TASK_SCHEMA, load_views, pending_children, read_table, virtual_projects
from tidemark.sources.versions import read_versions, write_version
from tidemark.streaming.feeds import scratch_path

LNOW = f"timestamp '{LIST_AS_OF}'"
TASK_COLS = ("id, task, project_id, date, priority, archived, user_id, ai_enhanced, metadata, "
             "parent_task_id, created_at, updated_at")


def duck_trim(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM_RE}', '', 'g')"


@register("scan_tasks", with_views(f"select {TASK_COLS} from tasks"))
def q_scan_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    return L.scan_tasks(t)


@register("scan_projects", with_views("select * from projects"))
def q_scan_projects(spark, sf):
    _, p = load_views(spark, sf)
    return L.scan_projects(p)


@register("conform_schema", with_views(f"""
select id, task, project_id, date, priority, archived, user_id, false as ai_enhanced, metadata,
       cast(null as bigint) as parent_task_id, created_at, {LNOW} as updated_at
from tasks"""))
def q_conform_schema(spark, sf):
    t, _ = load_views(spark, sf)
    base = t.drop("parent_task_id", "updated_at", "ai_enhanced")
    return L.conform_schema(base, TASK_SCHEMA, now=F.expr(f"timestamp_ntz'{LIST_AS_OF}'"))


@register("conform_versions", with_views(f"""
select id, task, project_id, date, priority, archived, user_id,
       case when id % 3 = 0 then false else ai_enhanced end as ai_enhanced, metadata,
       case when id % 3 <> 0 then parent_task_id end as parent_task_id, created_at,
       case when id % 3 = 2 then updated_at else {LNOW} end as updated_at
from tasks"""))
def q_conform_versions(spark, sf):
    """Three stored versions of the table, the first two with fewer columns and narrower ids, read as one."""
    t, _ = load_views(spark, sf)
    root, part = scratch_path(spark, "task-versions"), F.col("id") % 3
    narrow = F.col("id").cast("int").alias("id")
    write_version(t.where(part == 0).drop("parent_task_id", "updated_at", "ai_enhanced").withColumn("id", narrow), root, 1)
    write_version(t.where(part == 1).drop("updated_at").withColumn("parent_task_id", F.col("parent_task_id").cast("int")), root, 2)
    write_version(t.where(part == 2), root, 3)
    defaults = {"ai_enhanced": F.lit(False), "updated_at": F.expr(f"timestamp_ntz'{LIST_AS_OF}'")}
    return read_versions(spark, root, [1, 2, 3], TASK_SCHEMA, defaults)


def _raw_inserts(t):
    i = F.col("id")
    return t.select(
        "id", "task", "user_id",
        F.when(i % 5 == 0, F.lit("")).otherwise(F.col("project_id")).alias("project_id"),
        "date",
        F.when(i % 7 == 0, F.lit("")).otherwise(F.col("priority")).alias("priority"),
        F.when(i % 6 == 0, F.lit(None).cast("boolean")).otherwise(F.col("ai_enhanced")).alias("ai_enhanced"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.col("metadata")).alias("metadata"),
        F.when(i % 9 == 0, F.lit(0).cast("long")).otherwise(F.col("parent_task_id")).alias("parent_task_id"))


RAW_INSERTS_SQL = """raw_inserts as (
  select id, task, user_id,
         case when id % 5 = 0 then '' else project_id end as project_id, date,
         case when id % 7 = 0 then '' else priority end as priority,
         case when id % 6 = 0 then null else ai_enhanced end as ai_enhanced,
         case when id % 4 = 0 then '' else metadata end as metadata,
         case when id % 9 = 0 then cast(0 as bigint) else parent_task_id end as parent_task_id
  from tasks)"""

DEFAULTS_SQL = """select id, task, user_id, coalesce(nullif(project_id, ''), '1') as project_id,
       nullif(date, '') as date, coalesce(nullif(priority, ''), 'medium') as priority,
       coalesce(ai_enhanced, false) as ai_enhanced, coalesce(nullif(metadata, ''), '{}') as metadata,
       nullif(parent_task_id, 0) as parent_task_id
from raw_inserts"""


@register("apply_defaults", with_views(DEFAULTS_SQL, RAW_INSERTS_SQL))
def q_apply_defaults(spark, sf):
    t, _ = load_views(spark, sf)
    return L.apply_defaults(_raw_inserts(t))


@register("rename_case", with_views("""
select id, task, project_id as projectId, date, priority, archived, user_id as userId,
       ai_enhanced as aiEnhanced, metadata, parent_task_id as parentTaskId,
       created_at as createdAt, updated_at as updatedAt from tasks"""))
def q_rename_case(spark, sf):
    t, _ = load_views(spark, sf)
    return L.rename_case(t, "camel")


@register("expect_single", with_views("select count(*) as total_tasks, max(id) as max_id from tasks"))
def q_expect_single(spark, sf):
    t, _ = load_views(spark, sf)
    return L.expect_single(t.agg(F.count("*").alias("total_tasks"), F.max("id").alias("max_id")))


@register("user_scope", with_views("""
select v.user_id as viewer, t.id from tasks t join (select distinct user_id from projects) v
  on t.user_id = v.user_id"""))
def q_user_scope(spark, sf):
    t, p = load_views(spark, sf)
    viewers = p.select("user_id").distinct()
    return A.scope_user_frame(t, viewers).select("viewer", "id")


@register("dynamic_eq_filter", with_views(f"""
select {TASK_COLS} from tasks where archived = false and priority = 'high' and ai_enhanced = true"""))
def q_dynamic_eq_filter(spark, sf):
    t, _ = load_views(spark, sf)
    return L.eq_filter(t, {"archived": False, "priority": "high", "projectId": None, "aiEnhanced": True})


PARSED = "try_strptime(date, '%d/%m/%Y')::date"


@register("task_list", with_views(f"""
select {TASK_COLS} from tasks
where archived = false and priority = 'high'
  and {PARSED} <= cast({LNOW} as date) + interval 7 day"""))
def q_task_list(spark, sf):
    t, _ = load_views(spark, sf)
    return L.task_list(t, archived=False, priority="high", date_filter="NEXT_7", as_of=LIST_AS_OF)


@register("today_tasks", with_views(f"""
select {TASK_COLS} from tasks where archived = false and date = strftime({LNOW}, '%d/%m/%Y')"""))
def q_today_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    return L.today_tasks(t, as_of=LIST_AS_OF)


@register("next7_tasks", with_views(f"""
select {TASK_COLS} from tasks where archived = false
  and {PARSED} between cast({LNOW} as date) and cast({LNOW} as date) + interval 7 day"""))
def q_next7_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    return L.next7_tasks(t, as_of=LIST_AS_OF)


@register("inbox_tasks", with_views(f"""
select {TASK_COLS} from tasks where project_id = '1' and archived = false and (date is null or date = '')"""))
def q_inbox_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    return L.inbox_tasks(t)


@register("project_tasks", with_views(f"""
select {TASK_COLS} from tasks where project_id = '3' and archived = false"""))
def q_project_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    return L.project_tasks(t, "3", as_of=LIST_AS_OF)


@register("project_tasks_virtual", with_views(f"""
select 'INBOX' as selected, {TASK_COLS} from tasks
where project_id = '1' and archived = false and (date is null or date = '')
union all
select 'TODAY', {TASK_COLS} from tasks where archived = false and date = strftime({LNOW}, '%d/%m/%Y')
union all
select 'NEXT_7', {TASK_COLS} from tasks where archived = false
  and {PARSED} between cast({LNOW} as date) and cast({LNOW} as date) + interval 7 day"""))
def q_project_tasks_virtual(spark, sf):
    """The lists behind the three virtual sidebar entries."""
    t, _ = load_views(spark, sf)
    lists = [L.project_tasks(t, v, as_of=LIST_AS_OF).withColumn("selected", F.lit(v)) for v in ("INBOX", "TODAY", "NEXT_7")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@register("active_archived_split", with_views("""
select user_id, archived, count(*) as n_tasks from tasks group by user_id, archived"""))
def q_active_archived_split(spark, sf):
    t, _ = load_views(spark, sf)
    return L.active_archived_counts(t)


@register("project_projection", with_views("""
select *, id as docId, id as projectId, cast(0 as bigint) as taskCount, user_id as userId,
       created_at as createdAt, updated_at as updatedAt from projects"""))
def q_project_projection(spark, sf):
    _, p = load_views(spark, sf)
    return L.project_projection(p)


@register("parse_eligible", f"""
select conv_id, turn from conversations
where length(text) > 8
  and len(list_filter(regexp_split_to_array({duck_trim('text')}, '{JS_WS}+'), lambda x: length(x) > 0)) >= 2""")
def q_parse_eligible(spark, sf):
    c = read_table(spark, sf, "conversations")
    return L.parse_eligible(c, "text").select("conv_id", "turn")


@register("valid_messages", """
select conv_id, turn, role, text from conversations
where role is not null and role <> '' and text is not null and text <> ''""")
def q_valid_messages(spark, sf):
    return L.valid_messages(read_table(spark, sf, "conversations"))


def _ai_metadata(t):
    """Task rows with app-shaped metadata built from their own columns."""
    words = F.split(F.col("task"), " ")
    people = F.when(F.col("id") % 2 == 0, F.slice(words, 2, 2)).otherwise(F.array().cast("array<string>"))
    meta = F.to_json(F.struct(
        F.struct(F.get_json_object("metadata", "$.category").alias("category"),
                 people.alias("people")).alias("aiParsed"),
        F.when(F.col("parent_task_id").isNotNull(), F.lit("subtask")).alias("type")))
    return t.select("id", meta.alias("metadata"))


@register("metadata_fields", with_views("""
select id, json_extract_string(metadata, '$.category') as category,
       case when id % 2 = 0 and len(string_split(task, ' ')) >= 2
            then array_to_string(string_split(task, ' ')[2:3], ', ') end as people,
       parent_task_id is not null as is_subtask
from tasks"""))
def q_metadata_fields(spark, sf):
    t, _ = load_views(spark, sf)
    return L.metadata_fields(_ai_metadata(t))


@register("editable_text", with_views(f"""
select id, new_text from (
  select id, {duck_trim("case id % 3 when 0 then chr(9) || ' ' || chr(160) when 1 then chr(9) || task || chr(160) || ' ' else lower(task) end")} as new_text
  from tasks) e where length(new_text) > 0"""))
def q_editable_text(spark, sf):
    t, _ = load_views(spark, sf)
    i = F.col("id")
    edits = t.select("id", F.when(i % 3 == 0, F.lit("\t  "))
                     .when(i % 3 == 1, F.concat(F.lit("\t"), F.col("task"), F.lit("  ")))
                     .otherwise(F.lower("task")).alias("new_text"))
    return L.editable_text(edits)


@register("tasks_with_project", with_views("""
select t.id, t.user_id, t.project_id, coalesce(p.name, 'Unknown Project') as project_name
from tasks t left join projects p on t.project_id = p.id"""))
def q_tasks_with_project(spark, sf):
    t, p = load_views(spark, sf)
    return J.with_project_name(t.select("id", "user_id", "project_id"), p)


@register("tasks_inner_project", with_views("""
select t.id, p.id as project_ref_id, p.name as project_name
from tasks t join projects p on t.project_id = p.id"""))
def q_tasks_inner_project(spark, sf):
    t, p = load_views(spark, sf)
    r = J.with_inner_project(t.select("id", "project_id"), p)
    return r.select("id", F.col("project.id").alias("project_ref_id"), F.col("project.name").alias("project_name"))


@register("task_left_project_parent", with_views("""
select t.id, p.id as project_ref_id, p.name as project_ref_name, par.id as parent_id, par.task as parent_task
from tasks t left join projects p on t.project_id = p.id left join tasks par on t.parent_task_id = par.id"""))
def q_task_left_project_parent(spark, sf):
    t, p = load_views(spark, sf)
    r = J.with_project_and_parent(t, p)
    return r.select("id", "project_ref_id", "project_ref_name", "parent_id", "parent_task")


@register("parent_task", with_views("""
select t.id, par.id as parent_id, par.task as parent_task
from tasks t left join tasks par on t.parent_task_id = par.id"""))
def q_parent_task(spark, sf):
    t, _ = load_views(spark, sf)
    return J.with_parent(t.select("id", "parent_task_id")
                         , t.select("id", "task")).select("id", "parent_id", "parent_task")


@register("subtasks_nested", with_views("""
select t.id, coalesce(k.n, 0) as subtask_count, k.first_id as first_subtask_id, k.last_id as last_subtask_id
from tasks t left join (select parent_task_id, count(*) as n, min(id) as first_id, max(id) as last_id
                        from tasks where parent_task_id is not null group by parent_task_id) k
  on k.parent_task_id = t.id"""))
def q_subtasks_nested(spark, sf):
    t, _ = load_views(spark, sf)
    return J.subtask_counts(t)


@register("subtasks_list", with_views("""
select t.id, case when c.id is not null then row_number() over (partition by t.id order by c.id, c.task) end as child_pos,
       c.id as child_id, c.task as child_task
from tasks t left join tasks c on c.parent_task_id = t.id"""))
def q_subtasks_list(spark, sf):
    """The nested children, every one of them."""
    t, _ = load_views(spark, sf)
    return J.subtask_list(t)


@register("project_title", with_views("""
select t.id, t.project_id, coalesce(v.name, p.name) as title
from tasks t
left join (values ('INBOX', 'Inbox'), ('TODAY', 'Today'), ('NEXT_7', 'Next 7 Days')) v(id, name)
  on t.project_id = v.id
left join projects p on t.project_id = p.id"""))
def q_project_title(spark, sf):
    t, p = load_views(spark, sf)
    r = J.project_title(t.select("id", "project_id"), p, virtual_projects(spark), key="project_id")
    return r.select("id", "project_id", "title")


@register("task_hierarchy", with_views("""
select user_id, id, id as root_id, created_at as root_created_at, 0 as is_child, created_at from roots
union all
select k.user_id, k.id, r.id, r.created_at, 1, k.created_at
from kids k join roots r on k.user_id = r.user_id and k.parent_task_id = r.id
union all
select k.user_id, k.id, r.id, r.created_at, 1, k.created_at
from kids k join roots r on k.user_id = r.user_id and k.parent_task_id is null
  and json_extract_string(k.metadata, '$.parentTask') = r.task""",
    "firsts as (select user_id, min_by(task, id) as text from tasks where archived = false and parent_task_id is null "
    "group by user_id)",
    # every fifth child is pending: it names its user's first root by text
    "a as (select t.* replace (case when f.text is null or t.parent_task_id is null or t.id % 5 <> 0 then t.parent_task_id "
    "end as parent_task_id, case when f.text is null or t.parent_task_id is null or t.id % 5 <> 0 then t.metadata "
    "else json_object('parentTask', f.text)::varchar end as metadata) "
    "from tasks t left join firsts f on f.user_id = t.user_id where t.archived = false)",
    "roots as (select * from a where parent_task_id is null and json_extract_string(metadata, '$.parentTask') is null)",
    "kids as (select * from a where parent_task_id is not null or json_extract_string(metadata, '$.parentTask') is not null)"))
def q_task_hierarchy(spark, sf):
    t, _ = load_views(spark, sf)
    return J.task_hierarchy(pending_children(t).where(F.col("archived") == F.lit(False)))


@register("orphan_tasks", with_views("""
select t.id, t.project_id from tasks t where not exists (select 1 from projects p where p.id = t.project_id)"""))
def q_orphan_tasks(spark, sf):
    t, p = load_views(spark, sf)
    return J.orphan_tasks(t.select("id", "project_id"), p)


@register("last_messages", """
select conv_id, turn, role, text, 4 - rn as pos from (
  select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) x
where rn <= 3""")
def q_last_messages(spark, sf):
    return L.last_messages(read_table(spark, sf, "conversations"), n=3)


@register("context_tasks", with_views("""
select user_id, list_pos, id, task, priority, date, project_id as projectId, archived from (
  select *, row_number() over (partition by user_id order by created_at desc, id desc) as list_pos from tasks) x
where list_pos <= 20"""))
def q_context_tasks(spark, sf):
    t, _ = load_views(spark, sf)
    return L.context_tasks(t, n=20)


@register("newest_first", with_views("select id, user_id, created_at from tasks order by created_at desc, id desc"))
def q_newest_first(spark, sf):
    t, _ = load_views(spark, sf)
    return L.newest_first(t.select("id", "user_id", "created_at"))


@register("projects_ordered", with_views("select id, name, created_at from projects order by id"))
def q_projects_ordered(spark, sf):
    _, p = load_views(spark, sf)
    return L.projects_ordered(p.select("id", "name", "created_at"), by="id")


@register("ordered_json_agg", with_views(f"""
select user_id, row_number() over (partition by user_id order by date) as pos, date, completed,
       avg_completion_time_hours, ai_enhanced_completed
from (select user_id, cast(updated_at as date) as date, count(*) as completed,
             case when count(*) > 0 then cast(sum(date_diff('microsecond', created_at, updated_at)) as double)
                  / (cast(count(*) as double) * 3600000000.0::double) end as avg_completion_time_hours,
             count(*) filter (where ai_enhanced) as ai_enhanced_completed
      from tasks where archived and updated_at >= timestamp '{REPORT_AS_OF}' - interval 30 day
      group by user_id, cast(updated_at as date)) d"""))
def q_ordered_json_agg(spark, sf):
    t, _ = load_views(spark, sf)
    d = A.daily_completions(t, as_of=REPORT_AS_OF)
    return L.ordered_list_long(d, ["user_id"], ["date"],
                               ["completed", "avg_completion_time_hours", "ai_enhanced_completed"])
