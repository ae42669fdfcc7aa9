"""Closure over the parent tree (A7 delete cascade, J2 archive cascade).

Both ask which tasks have a named task above them on a path of certain
edges, and how far up the nearest one is. A task has one parent, so this is
pointer doubling: every row knows the task 2^k steps above it and the nearest
named task closer than that; one join of the rows with themselves doubles the
distance. A tree of depth d takes log2(d) rounds of one join each, a chain of
10,000 tasks 14. Rows that found a named task, or came to the end of their path, are not
joined again. Rows on a cycle without a named task never end; they are told by the
number of rounds, because no path without a repeated task is longer than
the number of edges. Every round is a reliable checkpoint in the session's
``spark.checkpoint.dir`` (a lost executor re-runs one round at most, and no
cached rows are left behind), and one count per round is all that reaches the
driver. Join strategies are left to the planner and AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def nearest_above(edges: DataFrame, named: DataFrame) -> DataFrame:
    """(id, level) of the ``named`` ids (level 0) and of all ids with one of them above.

    ``edges`` = (id, above) and ``named`` = (id); ``level`` counts the steps to
    the nearest. Repeated edges count once and ids may have several edges (then
    a path may take any); ids without a row are ends of paths; null ids are on
    no path.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    seeds = named.where(F.col("id").isNotNull()).select("id").distinct().withColumn("level", F.lit(0))
    steps = edges.where(F.col("id").isNotNull() & F.col("above").isNotNull()).select("id", "above").distinct()
    # a path ends at a named row: what lies above it is not asked
    open_rows = steps.join(seeds, "id", "left_anti").checkpoint()
    found = seeds.checkpoint()
    n_edges = n_open = open_rows.count()
    branching = n_open != open_rows.select("id").distinct().count()  # only tables with repeated ids
    reach = 1
    while n_open and reach <= n_edges:
        # each open row looks at the place ``reach`` steps above: named tasks near there, or the place as far above again
        ahead = (open_rows.select("id", "above", F.lit(None).cast("int").alias("level"))
                 .unionByName(found.select("id", F.lit(None).cast(open_rows.schema["above"].dataType).alias("above"), "level")))
        step = (open_rows.select(F.col("id").alias("_id"), F.col("above").alias("_at"))
                .join(ahead, F.col("_at") == F.col("id"))
                .select(F.col("_id").alias("id"), "above", (F.col("level") + reach).alias("level")))
        if branching:
            step = step.groupBy("id", "above").agg(F.min("level").alias("level"))
        step = step.checkpoint()
        near = step.where("level is not null").select("id", "level")
        open_rows = step.where("level is null").select("id", "above")
        if branching:
            near = near.groupBy("id").agg(F.min("level").alias("level"))
            open_rows = open_rows.join(near, "id", "left_anti")
        found = found.unionByName(near)
        n_open = open_rows.count()
        reach *= 2
    return found


def descendants(tasks: DataFrame, seeds: DataFrame) -> DataFrame:
    """All ids reachable from ``seeds.id`` through child links, with their level (id, level); seeds have level 0."""
    return nearest_above(tasks.select("id", F.col("parent_task_id").alias("above")), seeds)


def state_cascade(tasks: DataFrame, changes: DataFrame, state_col: str = "archived") -> DataFrame:
    """Propagate a boolean state change down the tree, through differing rows only.

    ``changes`` = (id, new_state). A change that flips the row seeds the
    cascade; a child whose current state differs from the parent's new state
    takes it and passes it on; a child already in that state stops the
    cascade below it. Rows named in ``changes`` keep their explicit value; an
    id named with both states is set.
    Returns (id, new_state, level) for every changed row (level 0 = explicit).

    A flip passes only rows that are in the state the seed had, so these are
    the rows under a flipped one over edges between rows of one state, with
    no edge out of an explicit row; they take the other state.
    """
    ensure_checkpoint_dir(tasks.sparkSession)
    nodes = tasks.select("id", "parent_task_id", F.col(state_col).alias("_state")).checkpoint()
    ch = changes.groupBy("id").agg(F.max(F.col("new_state").cast("boolean")).alias("new_state"))
    explicit = ch.join(nodes.select("id", "_state"), "id").checkpoint()
    above = nodes.select(F.col("id").alias("above"), F.col("_state").alias("_above_state"))
    edges = (nodes.join(explicit.select("id"), "id", "left_anti")
             .join(above, nodes["parent_task_id"] == above["above"])
             .where(F.col("_state") == F.col("_above_state")).select("id", "above"))
    flipped = explicit.where(F.col("new_state") != F.col("_state")).select("id")
    under = nearest_above(edges, flipped).where("level > 0").join(nodes.select("id", "_state"), "id")
    out = (explicit.select("id", "new_state", F.lit(0).alias("level"))
           .unionByName(under.select("id", (~F.col("_state")).alias("new_state"), "level")))
    return out.groupBy("id").agg(F.min_by("new_state", F.struct("level", "new_state")).alias("new_state"),
                                 F.min("level").alias("level"))
