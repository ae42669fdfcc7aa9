"""Data-quality checks (B9, B9b, B10; C8 lives in joins).

Each check returns long rows ``(rule, ...key)`` so that any number of rules
is one result; a passing table returns no rows. Row rules are evaluated in
one pass (an array of violated rule names, exploded); key rules are
aggregates, combined map-side before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The priority domain of the tasks table.
PRIORITY_DOMAIN = ["low", "medium", "high"]


def constraint_violations(tasks: DataFrame) -> DataFrame:
    """CHECK constraints; a NULL check result passes, as in SQL.

    check_priority: priority in (low, medium, high);
    check_task_not_empty: length(trim(task)) > 0 (SQL trim: spaces only);
    check_no_self_parent: id <> parent_task_id.
    """
    checks = {
        "check_priority": F.col("priority").isin(*PRIORITY_DOMAIN),
        "check_task_not_empty": F.length(F.trim(F.col("task"))) > 0,
        "check_no_self_parent": F.col("id") != F.col("parent_task_id"),
    }
    failed = F.array_compact(F.array(*[F.when(cond == F.lit(False), F.lit(name))
                                       for name, cond in checks.items()]))
    return (tasks.select("id", failed.alias("_failed")).where(F.size("_failed") > 0)
            .select(F.explode("_failed").alias("rule"), "id"))


def _duplicates(df: DataFrame, table: str, key: str) -> DataFrame:
    return (df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
            .select(F.lit(table).alias("table_name"), F.lit("unique_" + key).alias("rule"),
                    F.col(key).cast("string").alias("key"), "n"))


def _nulls(df: DataFrame, table: str, col: str, key: str) -> DataFrame:
    return (df.where(F.col(col).isNull())
            .select(F.lit(table).alias("table_name"), F.lit("not_null_" + col).alias("rule"),
                    F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n")))


def key_violations(tasks: DataFrame, projects: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """NOT NULL task/name, unique primary keys, unique user in the stored statistics."""
    parts = [_nulls(tasks, "tasks", "task", "id"), _duplicates(tasks, "tasks", "id"),
             _nulls(projects, "projects", "name", "id"), _duplicates(projects, "projects", "id")]
    if statistics is not None:
        parts.append(_duplicates(statistics, "user_statistics", "user_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parent_fk_violations(tasks: DataFrame) -> DataFrame:
    """Tasks whose parent id does not exist."""
    ids = tasks.select(F.col("id").alias("_pid"))
    kids = tasks.where(F.col("parent_task_id").isNotNull()).select("id", "parent_task_id")
    return kids.join(ids, kids["parent_task_id"] == ids["_pid"], "left_anti")
