"""Bulk text enrichment jobs over a text column.

The reference parses one text per HTTP request; these operators enrich a
whole table in one pass of column expressions (no UDF), and list-valued
results are exploded to long rows where a flat result is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import enrich as E
from tidemark.functions import rules as R
from tidemark.functions.text import js_trim


def smart_parse(df: DataFrame, text_col: str = "task", out: str = "parsed") -> DataFrame:
    """Add the parse result struct (quick prefix rules, else rule parser)."""
    return E.with_smart_parse(df, text_col, out)


def smart_parse_flat(df: DataFrame, text_col: str = "task", key: str = "id") -> DataFrame:
    """H11 flat: one row per text with list fields joined (people ', ', tags ',', suggestions ' | ')."""
    p = smart_parse(df.select(key, text_col), text_col)
    return p.select(
        key, F.col("parsed.taskName").alias("task_name"), F.col("parsed.date").alias("date"),
        F.col("parsed.time").alias("time"), F.col("parsed.priority").alias("priority"),
        F.array_join("parsed.people", ", ").alias("people"), F.col("parsed.category").alias("category"),
        F.array_join("parsed.tags", ",").alias("tags"),
        F.col("parsed.estimatedDuration").alias("estimated_duration"),
        F.array_join("parsed.suggestions", " | ").alias("suggestions"),
        F.col("parsed.confidence").alias("confidence"), F.col("parsed.fastResponse").alias("fast_response"))


def breakdown(df: DataFrame, text_col: str = "task", key: str = "id") -> DataFrame:
    """H12 + H13: one row per step: (key, step, task, priority, estimated_time, total)."""
    t = js_trim(F.col(text_col))
    steps = df.select(key, E.breakdown_steps(t).alias("_s"), E.breakdown_total_time(t).alias("total_estimated_time"),
                      F.when(E.breakdown_key(t).isNull(), F.lit(R.GENERIC_BREAKDOWN_NOTE)).alias("suggestion"))
    return steps.select(key, F.posexplode("_s").alias("step", "_e"), "total_estimated_time", "suggestion").select(
        key, (F.col("step") + 1).alias("step"), F.col("_e.task").alias("task"),
        F.col("_e.priority").alias("priority"), F.col("_e.estimatedTime").alias("estimated_time"),
        "total_estimated_time", "suggestion")


def prioritize(tasks: DataFrame, text_col: str = "task", title_col: str | None = None) -> DataFrame:
    """Each task with its keyword priority and the reasoning text."""
    txt: Column = F.col(text_col)
    if title_col is not None:
        txt = F.coalesce(F.nullif(F.col(title_col), F.lit("")), txt)
    return tasks.withColumn("ai_priority", E.ai_priority(txt)).withColumn("reasoning", E.priority_reasoning(txt))


def suggestions(df: DataFrame, text_col: str = "task", key: str = "id") -> DataFrame:
    """H15 long form: (key, category, kind, pos, text) for suggestions and related actions."""
    def rows(kind: str, texts: list[str]) -> list[Column]:
        return [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("pos"), F.lit(x).alias("text")) for i, x in enumerate(texts)]

    def listed(texts: list[str]) -> Column:
        return F.array(*rows("suggestion", texts), *rows("related_action", R.RELATED_ACTIONS))
    # the text is trimmed and searched once a row; the rows of each topic are constants
    found = (df.select(key, js_trim(F.col(text_col)).alias("_text"))
             .select(key, E.suggestion_topic(F.col("_text")).alias("_topic")))
    return found.select(key, F.coalesce("_topic", F.lit(R.DEFAULT_CATEGORY)).alias("category"),
                        F.inline(E.by_topic(F.col("_topic"), listed)))


def schedule(df: DataFrame, text_col: str = "task", key: str = "id",
             existing_count: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scheduling recommendations; H17 conflicts from ``existing_count``; ``carry`` columns ride along."""
    t = js_trim(F.col(text_col))
    return df.select(
        key, *carry, E.best_time(t).alias("best_time"), E.estimate_duration(t).alias("duration"),
        E.preparation_time(t).alias("preparation"),
        F.array_join(F.array(*[F.lit(r) for r in R.REMINDERS]), " | ").alias("reminders"),
        E.schedule_conflicts(existing_count if existing_count is not None else F.lit(0)).alias("conflicts"),
        F.array_join(F.array(*[F.lit(a) for a in R.ALTERNATIVES]), " | ").alias("alternatives"),
        E.buffer_time(t).alias("buffer_time"))


def schedule_with_conflicts(tasks: DataFrame, text_col: str = "task") -> DataFrame:
    """Schedule each task against the user's other active tasks (count joined back)."""
    counts = (tasks.where(F.col("archived") == F.lit(False)).groupBy(F.col("user_id").alias("_u"))
              .agg(F.count("*").alias("_existing")))
    j = tasks.join(counts, tasks["user_id"] == counts["_u"], "left")
    return schedule(j, text_col, existing_count=F.col("_existing"), carry=("user_id",))


def suggestions_to_subtasks(parents: DataFrame, steps_col: str, selected: Column | None = None,
                            project_col: str = "project_id") -> DataFrame:
    """Chosen suggestions become child rows under their main task.

    ``steps_col`` is an array of strings or of (task, priority,
    estimatedTime) structs; ``selected(pos)`` (0-based) picks the chosen
    ones. Priority defaults to 'low'; metadata names the parent text and
    drops an absent estimatedTime (as JSON.stringify drops undefined).
    """
    exploded = parents.select("id", "task", project_col, F.posexplode(steps_col).alias("pos", "_s"))
    if selected is not None:
        exploded = exploded.where(selected)
    is_struct = isinstance(parents.schema[steps_col].dataType.elementType, T.StructType)
    if is_struct:
        text, prio, est = F.col("_s.task"), F.col("_s.priority"), F.col("_s.estimatedTime")
    else:
        text, prio, est = F.col("_s"), F.lit(None).cast("string"), F.lit(None).cast("string")
    meta = F.to_json(F.struct(F.col("task").alias("parentTask"), F.lit("subtask").alias("type"),
                              F.lit(True).alias("aiGenerated"), est.alias("estimatedTime")))
    return exploded.select(
        F.col("id").alias("parent_task_id"), "pos", text.alias("task"),
        F.coalesce(F.nullif(F.col(project_col), F.lit("")), F.lit("1")).alias("project_id"),
        F.lit("").alias("date"), F.coalesce(prio, F.lit("low")).alias("priority"),
        F.lit(True).alias("ai_enhanced"), meta.alias("metadata"))


def parsed_to_task(df: DataFrame, text_col: str = "task", parsed_col: str = "parsed",
                   project_col: str = "project_id") -> DataFrame:
    """A parse result becomes the task row to store (raw input when not parsed)."""
    p = F.col(parsed_col)
    has = p.isNotNull()
    return df.select(
        "id",
        F.when(has, F.coalesce(F.nullif(p.getField("taskName"), F.lit("")), F.col(text_col)))
         .otherwise(F.col(text_col)).alias("task"),
        F.coalesce(F.nullif(F.col(project_col), F.lit("")), F.lit("1")).alias("project_id"),
        F.when(has, F.coalesce(F.nullif(p.getField("date"), F.lit("")), F.lit(""))).otherwise(F.lit("")).alias("date"),
        F.when(has, F.coalesce(F.nullif(p.getField("priority"), F.lit("")), F.lit("medium")))
         .otherwise(F.lit("medium")).alias("priority"),
        has.alias("ai_enhanced"),
        F.when(has, F.col(text_col)).alias("original_input"),
        F.when(has, p.getField("confidence")).alias("confidence"))


def embedded_json(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """The text as JSON, else its outermost ``{...}`` span, else NULL."""
    t = F.col(text_col)
    span = F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))
    whole_ok = F.try_parse_json(t).isNotNull()
    span_ok = F.try_parse_json(span).isNotNull()
    return df.select(
        key,
        F.when(whole_ok, F.lit("whole")).when(span_ok, F.lit("embedded")).alias("source"),
        F.when(whole_ok, t).when(span_ok, span).alias("json_text"))


def task_context_text(context: DataFrame) -> DataFrame:
    """Per user the chat context block listing the active context tasks.

    ``context`` = E4 output (user_id, list_pos, task, priority, date,
    archived). A user with context tasks gets the header with the active
    count even when none is active; a NULL priority prints as "null".
    """
    line = F.concat(F.lit("- "), F.col("task"), F.lit(" (Priority: "), F.coalesce(F.col("priority"), F.lit("null")),
                    F.when(F.coalesce(F.col("date"), F.lit("")) != "",
                           F.concat(F.lit(", Due: "), F.col("date"))).otherwise(F.lit("")), F.lit(")"))
    active = F.col("archived") == F.lit(False)
    g = context.groupBy("user_id").agg(
        F.count_if(active).alias("active_tasks"),
        F.sort_array(F.collect_list(F.when(active, F.struct("list_pos", line.alias("line"))))).alias("_lines"))
    body = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    head = R.CONTEXT_HEADER.split("{n}")
    return g.select("user_id", "active_tasks",
                    F.concat(F.lit(head[0]), F.col("active_tasks").cast("string"), F.lit(head[1]), body,
                             F.lit(R.CONTEXT_FOOTER)).alias("context_text"))


def due_date_choices(df: DataFrame, ts_col: str = "created_at", key: str = "id") -> DataFrame:
    """Today / tomorrow / next week (+7) as DD/MM/YYYY from a timestamp."""
    d = F.to_date(F.col(ts_col))
    fmt = "dd/MM/yyyy"
    return df.select(key, F.date_format(d, fmt).alias("today"), F.date_format(F.date_add(d, 1), fmt).alias("tomorrow"),
                     F.date_format(F.date_add(d, 7), fmt).alias("next_week"))


def feature_dispatch(requests: DataFrame, feature_col: str = "feature", text_col: str = "text",
                     key: str = "id") -> DataFrame:
    """Route each (feature, text) request; unknown features parse.

    The answer is summarised in one text column: smart-parse -> task name,
    task-breakdown -> first step, smart-prioritize -> priority,
    contextual-suggestions -> first suggestion, smart-scheduling -> best time.
    """
    t = js_trim(F.col(text_col))
    f = F.col(feature_col)
    routed = F.when(f.isin(*R.FEATURES), f).otherwise(F.lit(R.DEFAULT_FEATURE))
    answer = (F.when(routed == "task-breakdown", E.breakdown_steps(t)[0]["task"])
              .when(routed == "smart-prioritize", E.ai_priority(F.col(text_col)))
              .when(routed == "contextual-suggestions", E.contextual_suggestions(t)[0])
              .when(routed == "smart-scheduling", E.best_time(t))
              .otherwise(F.col("_parsed.taskName")))
    parsed = E.with_smart_parse(requests, text_col, "_parsed")
    return parsed.select(key, routed.alias("feature_used"), answer.alias("answer"))
