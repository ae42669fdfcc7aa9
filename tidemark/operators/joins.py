"""Joins of tasks with projects, parents and children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import UNKNOWN_PROJECT
from tidemark.session import ensure_checkpoint_dir


def with_project_name(tasks: DataFrame, projects: DataFrame,
                      name_col: str = "project_name", coalesce_unknown: bool = True) -> DataFrame:
    """LEFT join on project id only (not on user), name defaults to 'Unknown Project'.

    No broadcast hint: the projects table grows with the number of users, so
    the planner decides from its size (static threshold, or AQE at runtime).
    """
    p = projects.select(F.col("id").alias("_p_id"), F.col("name").alias("_p_name"))
    name = F.coalesce(F.col("_p_name"), F.lit(UNKNOWN_PROJECT)) if coalesce_unknown else F.col("_p_name")
    return (tasks.join(p, tasks["project_id"] == p["_p_id"], "left")
            .withColumn(name_col, name).drop("_p_id", "_p_name"))


def with_inner_project(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """INNER embed of project(id, name) as a struct column ``project``."""
    p = projects.select(F.col("id").alias("_p_id"), F.col("name").alias("_p_name"))
    return (tasks.join(p, tasks["project_id"] == p["_p_id"], "inner")
            .withColumn("project", F.struct(F.col("_p_id").alias("id"), F.col("_p_name").alias("name")))
            .drop("_p_id", "_p_name"))


def with_parent(tasks: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Self LEFT join child -> parent, adds ``parent_id`` and ``parent_task``."""
    src = tasks if parents is None else parents
    par = src.select(F.col("id").alias("parent_id"), F.col("task").alias("parent_task"))
    return tasks.join(par, tasks["parent_task_id"] == par["parent_id"], "left")


def with_project_and_parent(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """LEFT embed of project and parent (what a write returns)."""
    p = projects.select(F.col("id").alias("project_ref_id"), F.col("name").alias("project_ref_name"))
    t = tasks.join(p, tasks["project_id"] == p["project_ref_id"], "left")
    return with_parent(t, tasks)


def with_subtasks(tasks: DataFrame) -> DataFrame:
    """C4: each task with the array of its children (empty array if none).

    Children are pre-aggregated per parent (partial aggregation before the
    shuffle) and joined back on the parent id.
    """
    kids = (tasks.where(F.col("parent_task_id").isNotNull())
            .groupBy(F.col("parent_task_id").alias("_parent"))
            .agg(F.sort_array(F.collect_list(F.struct("id", "task"))).alias("subtasks")))
    empty = F.array().cast("array<struct<id:bigint,task:string>>")
    return (tasks.join(kids, tasks["id"] == kids["_parent"], "left").drop("_parent")
            .withColumn("subtasks", F.coalesce(F.col("subtasks"), empty)))


def subtask_list(tasks: DataFrame) -> DataFrame:
    """C4 in full and flat: (id, child_pos, child_id, child_task), one row per child in the order of the
    embedded array (id, text); a task without children has one row of NULLs."""
    out = with_subtasks(tasks).select("id", F.posexplode_outer("subtasks").alias("_pos", "_child"))
    return out.select("id", (F.col("_pos") + 1).cast("long").alias("child_pos"), F.col("_child.id").alias("child_id"),
                      F.col("_child.task").alias("child_task"))


def subtask_counts(tasks: DataFrame) -> DataFrame:
    """C4 flat form: per task the number of children and the smallest/largest child id."""
    kids = (tasks.where(F.col("parent_task_id").isNotNull())
            .groupBy(F.col("parent_task_id").alias("_parent"))
            .agg(F.count("*").alias("subtask_count"),
                 F.min("id").alias("first_subtask_id"),
                 F.max("id").alias("last_subtask_id")))
    return (tasks.select("id").join(kids, F.col("id") == F.col("_parent"), "left").drop("_parent")
            .withColumn("subtask_count", F.coalesce("subtask_count", F.lit(0)).cast("long")))


def project_title(selected: DataFrame, projects: DataFrame, virtual: DataFrame,
                  key: str = "selected_project") -> DataFrame:
    """Title of the selected list: virtual list name first, else project name.

    The virtual dimension has 3 rows (broadcast); projects is sized by the planner.
    """
    v = virtual.select(F.col("id").alias("_v_id"), F.col("name").alias("_v_name"))
    p = projects.select(F.col("id").alias("_p_id"), F.col("name").alias("_p_name"))
    return (selected.join(F.broadcast(v), F.col(key) == F.col("_v_id"), "left")
            .join(p, F.col(key) == F.col("_p_id"), "left")
            .withColumn("title", F.coalesce("_v_name", "_p_name"))
            .drop("_v_id", "_v_name", "_p_id", "_p_name"))


def orphan_tasks(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Tasks whose project does not exist (what 'Unknown Project' hides)."""
    p = projects.select(F.col("id").alias("_p_id"))
    return tasks.join(p, tasks["project_id"] == p["_p_id"], "left_anti")


BLOCK_SIDE = 1000        # pending children and roots of one text that meet in a block
TASK_ROWS = 2_000_000    # matches by text that a task makes, about


def _by_text(pending: DataFrame, roots: DataFrame, scope: list[str]) -> DataFrame:
    """Each pending child with every root of its list that has its parent's text.

    A text with k children and r roots has k * r matches, however few bytes its rows are: they are cut into
    blocks of about BLOCK_SIDE children by BLOCK_SIDE roots, which are dealt over a number of tasks that is
    set by the matches. A row is copied once for every BLOCK_SIDE rows of the other side.
    """
    kid_key = F.struct(*scope, F.col("_pp").alias("text"))
    root_key = F.struct(*[F.col("_r_" + c).alias(c) for c in scope], F.col("_r_task").alias("text"))
    sizes = (pending.groupBy(kid_key.alias("_at")).agg(F.count("*").alias("_k"))
             .join(roots.groupBy(root_key.alias("_at")).agg(F.count("*").alias("_n")), "_at"))
    ensure_checkpoint_dir(pending.sparkSession)
    sizes = sizes.checkpoint()
    matches = int(sizes.agg(F.coalesce(F.sum(F.col("_k") * F.col("_n")), F.lit(0))).first()[0])
    tasks = max(int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-matches // TASK_ROWS))
    side = lambda c: F.ceil(F.col(c) / BLOCK_SIDE).cast("int")
    cuts = sizes.select("_at", side("_k").alias("_rows"), side("_n").alias("_cols"))

    def block(row: Column, col: Column) -> Column:
        return F.struct("_at", row.alias("row"), col.alias("col")).alias("_block")

    def own(id_col: str, created: str, n: str) -> Column:
        return F.pmod(F.xxhash64(id_col, created), F.col(n)).cast("int")

    def others(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_other")
    k = (pending.withColumn("_at", kid_key).join(cuts, "_at").select("*", others("_cols"))
         .select(*pending.columns, block(own("id", "created_at", "_rows"), F.col("_other"))))
    n = (roots.withColumn("_at", root_key).join(cuts, "_at").select("*", others("_rows"))
         .select(*roots.columns, block(F.col("_other"), own("_r_id", "_r_created_at", "_cols"))))
    # dealt by number: adaptive coalescing would go by the few bytes of the rows
    return k.repartition(tasks, "_block").join(n.repartition(tasks, "_block"), "_block").drop("_block")


def task_hierarchy(tasks: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Roots in list order (newest first), each followed by its children (depth 1).

    A child whose parent is not a root of the same list is dropped. A
    'pending' child (no parent id, ``metadata.parentTask`` = parent text)
    matches its root by text. The display order is carried as sort-key
    columns (root_created_at desc, root_id desc, is_child, created_at desc,
    id desc) built with joins only; ``display_order`` applies it with a global
    range-partitioned sort, so one huge list never lands in a single task.
    Every pending child is under every root of its text, so the rows grow with
    the product of the two: they are joined in blocks, see ``_by_text``.
    """
    scope = scope or ["user_id"]
    pending_parent = F.get_json_object("metadata", "$.parentTask")
    is_child = F.col("parent_task_id").isNotNull() | pending_parent.isNotNull()
    base = tasks.select(*scope, "id", "task", "created_at", "parent_task_id",
                        pending_parent.alias("_pp"), is_child.alias("_child"))
    roots = base.where(~F.col("_child"))
    kids = base.where(F.col("_child"))
    r = roots.select(*[F.col(c).alias("_r_" + c) for c in scope],
                     F.col("id").alias("_r_id"), F.col("task").alias("_r_task"),
                     F.col("created_at").alias("_r_created_at"))
    same_scope = [kids[c].eqNullSafe(r["_r_" + c]) for c in scope]
    by_id = kids.join(r, same_scope + [kids["parent_task_id"] == r["_r_id"]], "inner")
    by_text = _by_text(kids.where(F.col("parent_task_id").isNull()), r, scope)
    cols = [*scope, "id", "root_id", "root_created_at", "is_child", "created_at"]
    children = by_id.unionByName(by_text).select(
        *scope, "id", F.col("_r_id").alias("root_id"),
        F.col("_r_created_at").alias("root_created_at"), F.lit(1).alias("is_child"), "created_at")
    rootrows = roots.select(*scope, "id", F.col("id").alias("root_id"),
                            F.col("created_at").alias("root_created_at"),
                            F.lit(0).alias("is_child"), "created_at")
    return rootrows.select(*cols).unionByName(children.select(*cols))


def display_order(hierarchy: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Sort a ``task_hierarchy`` result into display order (global sort)."""
    scope = scope or ["user_id"]
    return hierarchy.orderBy(*scope, F.col("root_created_at").desc(), F.col("root_id").desc(),
                             "is_child", F.col("created_at").desc(), F.col("id").desc())
