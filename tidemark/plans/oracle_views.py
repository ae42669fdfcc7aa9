"""DuckDB text of the derived views, put in front of each oracle query.

These mirror ``tidemark.sources.tables`` in the DuckDB dialect; they are the
independent side of the correctness check, so they are written by hand from
FIXTURES.md rather than generated from the Spark code.
"""

from tidemark.functions import rules as R

from tidemark.sources.tables import RULE_TEXTS, TASK_TEMPLATES

_BASE = ("(timestamp '2024-01-01 00:00:00' + "
         "to_minutes(cast((o.o_orderkey*7919) % 172800 as bigint)))")
_TEMPLATES = ", ".join("'" + t.replace("'", "''") + "'" for t in TASK_TEMPLATES)

TASKS_SQL = f"""select o.o_orderkey + 1 as id,
       concat(list_extract([{_TEMPLATES}], cast(o.o_orderkey % 12 as int)+1), ' ', p.p_name) as task,
       cast(o.o_custkey % 30 as varchar) as project_id,
       case when o.o_orderkey % 4 = 0 then null
            when o.o_orderkey % 4 = 1 then ''
            else strftime({_BASE} + interval 10 day, '%d/%m/%Y') end as date,
       case substr(o.o_orderpriority,1,1) when '1' then 'high' when '2' then 'high'
            when '3' then 'medium' when '5' then 'low' end as priority,
       o.o_orderstatus = 'F' as archived,
       concat('u', cast(o.o_custkey % 20 as varchar)) as user_id,
       o.o_orderkey % 3 = 0 as ai_enhanced,
       case when o.o_orderkey % 5 <> 0
            then concat('{{"category":"', lower(c.c_mktsegment), '","tags":["',
                        lower(substr(o.o_orderpriority,3)), '"]}}') end as metadata,
       case when (o.o_orderkey+1) % 4 <> 0 and o.o_orderkey >= 2
            then cast(floor((o.o_orderkey+1)/3) as bigint) end as parent_task_id,
       {_BASE} as created_at,
       {_BASE} + to_minutes(cast((o.o_orderkey*131) % 20160 as bigint)) as updated_at
from orders o
join customer c on c.c_custkey = o.o_custkey
join part p on p.p_partkey = o.o_orderkey % 200"""

PROJECTS_SQL = """select cast(n_nationkey as varchar) as id, n_name as name,
       concat('u', cast(n_nationkey % 20 as varchar)) as user_id,
       timestamp '2024-01-01 00:00:00' + to_hours(cast(n_nationkey as bigint)) as created_at,
       timestamp '2024-01-01 00:00:00' + to_hours(cast(n_nationkey as bigint)) as updated_at
from nation"""

DIRTY_SQL = """dirty0 as (
  select * replace (
    case when id % 11 = 0 then '' else task end as task,
    case when id % 13 = 0 then 'urgent' else priority end as priority,
    case when id % 17 = 0 then id else parent_task_id end as parent_task_id)
  from tasks where id % 7 <> 0),
dirty as (select * from dirty0 union all select * from dirty0 where id % 19 = 0)"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SYSTEM_SQL = _text(R.SYSTEM_PROMPT)

# the chat context block per user
CONTEXT_SQL = f"""select user_id, count(*) filter (where not archived) as active_tasks,
       {_text(R.CONTEXT_HEADER.split('{n}')[0])} || cast(count(*) filter (where not archived) as varchar)
       || {_text(R.CONTEXT_HEADER.split('{n}')[1])}
       || coalesce(string_agg(case when not archived then '- ' || task || ' (Priority: ' || coalesce(priority, 'null')
            || case when coalesce(date, '') <> '' then ', Due: ' || date else '' end || ')' end, chr(10)
            order by list_pos), '')
       || {_text(R.CONTEXT_FOOTER)} as context_text
from (select *, row_number() over (partition by user_id order by created_at desc, id desc) as list_pos from tasks) x
where list_pos <= 20 group by user_id"""


RULE_TEXTS_SQL = f"""select * replace (case when (id // 12) % 2 = 0
    then list_extract([{", ".join(_text(t) for t in RULE_TEXTS)}], cast((id // 24) % {len(RULE_TEXTS)} as int) + 1)
    else task end as task) from plain_tasks"""

ANSWERS_SQL = """select * replace (case when (event_id // 8) % 4 <> 0 then '{' || concat_ws(',',
      case when event_id % 2 = 0 then '"taskName":"' || event_type || '"' end,
      case event_id % 3 when 0 then '"priority":"low"' when 1 then '"priority":""' end,
      case when event_id % 5 <> 0 then '"category":"work"' end,
      case when event_id % 7 <> 0 then '"estimatedDuration":"1 hour"' end,
      case when event_id % 4 <> 0 then '"confidence":0.' || (event_id % 10) end) || '}'
    else props end as props) from events"""


def with_texts(body: str, *extra_ctes: str) -> str:
    """As ``with_views``, with the tasks whose texts reach every arm of the text rules."""
    ctes = [f"plain_tasks as (\n{TASKS_SQL}\n)", f"tasks as (\n{RULE_TEXTS_SQL}\n)", *extra_ctes]
    return "with " + ",\n".join(ctes) + "\n" + body


def with_views(body: str, *extra_ctes: str) -> str:
    """Prefix ``body`` with the tasks/projects CTEs (and any extra CTEs)."""
    ctes = [f"tasks as (\n{TASKS_SQL}\n)", f"projects as (\n{PROJECTS_SQL}\n)"]
    ctes.extend(extra_ctes)
    return "with " + ",\n".join(ctes) + "\n" + body
