"""Registered data-quality checks (B9, B9b, B10) on the dirty copy of the tasks."""

from __future__ import annotations

from tidemark.operators import analytics as A
from tidemark.operators import quality as Q
from tidemark.plans.oracle_views import DIRTY_SQL, with_views
from tidemark.plans.registry import register
from tidemark.sources.tables import dirty_tasks, load_views


@register("constraint_violations", with_views("""
select 'check_priority' as rule, id from dirty where not (priority in ('low', 'medium', 'high'))
union all select 'check_task_not_empty', id from dirty where not (length(trim(task)) > 0)
union all select 'check_no_self_parent', id from dirty where not (id <> parent_task_id)""", DIRTY_SQL))
def q_constraint_violations(spark, sf):
    t, _ = load_views(spark, sf)
    return Q.constraint_violations(dirty_tasks(t))


@register("key_violations", with_views("""
select 'tasks' as table_name, 'not_null_task' as rule, cast(id as varchar) as key, cast(1 as bigint) as n
  from dirty where task is null
union all select 'tasks', 'unique_id', cast(id as varchar), count(*) from dirty group by id having count(*) > 1
union all select 'projects', 'not_null_name', id, 1 from projects where name is null
union all select 'projects', 'unique_id', id, count(*) from projects group by id having count(*) > 1
union all select 'user_statistics', 'unique_user_id', user_id, count(*)
  from (select user_id from dirty group by user_id) s group by user_id having count(*) > 1""", DIRTY_SQL))
def q_key_violations(spark, sf):
    t, p = load_views(spark, sf)
    d = dirty_tasks(t)
    return Q.key_violations(d, p, A.user_statistics(d))


@register("parent_fk_violations", with_views("""
select k.id, k.parent_task_id from dirty k
where k.parent_task_id is not null and not exists (select 1 from dirty p where p.id = k.parent_task_id)""",
    DIRTY_SQL))
def q_parent_fk_violations(spark, sf):
    t, _ = load_views(spark, sf)
    return Q.parent_fk_violations(dirty_tasks(t))
