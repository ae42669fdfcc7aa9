"""Scans, filtered task lists, projections and top-n lists (A1-A4, A14, A15,
B1-B8, B11-B14, E3, E4, F1, F2, F4).

Filters are plain column predicates so Catalyst pushes them into the parquet
scan; nothing here collects data to the driver. Top-n per group uses
``row_number() <= n``: Spark plans a partial WindowGroupLimit before the
shuffle, so each map task sends at most n rows per group even when a single
group holds a large share of all rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.common import ts_lit
from tidemark.functions.text import js_trim
from tidemark.sources.tables import PROJECT_SCHEMA, TASK_SCHEMA

DATE_FMT = "dd/MM/yyyy"
VIRTUAL_IDS = ("INBOX", "TODAY", "NEXT_7")


# --------------------------------------------------------------------------
# A: scans, schema, defaults, renames
# --------------------------------------------------------------------------

def scan_tasks(tasks: DataFrame) -> DataFrame:
    """A1: the full-width task read, conformed to the task schema."""
    return conform_schema(tasks, TASK_SCHEMA)


def scan_projects(projects: DataFrame, user_id: str | None = None, order_by: str = "created_at") -> DataFrame:
    """A2: projects of a user ordered by ``created_at`` (or ``id``, older client)."""
    p = projects if user_id is None else projects.where(F.col("user_id") == user_id)
    return p.orderBy(F.col(order_by).asc(), F.col("id").asc())


# Column defaults of the task and project tables.
TASK_DEFAULTS = {
    "project_id": "1",
    "priority": "medium",
    "archived": False,
    "user_id": "demo-user",
    "ai_enhanced": False,
}
PROJECT_DEFAULTS = {"user_id": "demo-user"}


def conform_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None,
                   now: Column | None = None) -> DataFrame:
    """A3: add absent columns (ADD COLUMN IF NOT EXISTS) with their defaults.

    Timestamps default to ``now`` (NOW()); other absent columns to the
    table default or NULL. Present columns are cast to the schema type.
    """
    if defaults is None:
        defaults = TASK_DEFAULTS if schema is TASK_SCHEMA else (
            PROJECT_DEFAULTS if schema is PROJECT_SCHEMA else {})
    now = F.localtimestamp() if now is None else now
    cols = []
    present = set(df.columns)
    for f in schema.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.TimestampNTZType):
            cols.append(now.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def apply_defaults(rows: DataFrame) -> DataFrame:
    """A4: insert defaults with the client's falsy rules.

    project '' -> '1', date '' -> NULL, priority '' -> 'medium', AI flag
    NULL -> false, metadata empty -> '{}', parent 0 -> NULL.
    """
    c = F.col
    out = rows
    if "project_id" in rows.columns:
        out = out.withColumn("project_id", F.coalesce(F.nullif(c("project_id"), F.lit("")), F.lit("1")))
    if "date" in rows.columns:
        out = out.withColumn("date", F.nullif(c("date"), F.lit("")))
    if "priority" in rows.columns:
        out = out.withColumn("priority", F.coalesce(F.nullif(c("priority"), F.lit("")), F.lit("medium")))
    if "ai_enhanced" in rows.columns:
        out = out.withColumn("ai_enhanced", F.coalesce(c("ai_enhanced"), F.lit(False)))
    if "metadata" in rows.columns:
        out = out.withColumn("metadata", F.coalesce(F.nullif(c("metadata"), F.lit("")), F.lit("{}")))
    if "parent_task_id" in rows.columns:
        out = out.withColumn("parent_task_id", F.nullif(c("parent_task_id"), F.lit(0).cast("long")))
    return out


def to_camel(name: str) -> str:
    """snake_case -> camelCase: each ``_x`` (x lower-case letter) becomes ``X``."""
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def to_snake(name: str) -> str:
    """camelCase -> snake_case: each capital ``X`` becomes ``_x``."""
    return re.sub(r"([A-Z])", r"_\1", name).lower()


def rename_case(df: DataFrame, to: str = "camel") -> DataFrame:
    """Rename all columns between snake_case and camelCase."""
    conv = to_camel if to == "camel" else to_snake
    return df.toDF(*[conv(c) for c in df.columns])


def expect_single(df: DataFrame) -> DataFrame:
    """``df`` if it has exactly one row; else its action raises.

    The count of at most two rows is part of the same plan, so the input runs
    once and nothing runs while the plan is built.
    """
    rows = F.collect_list(F.struct(*[F.col(c) for c in df.columns]))
    ok = F.assert_true(F.size("_rows") == 1, F.concat(
        F.lit("expected exactly one row, got "), F.when(F.size("_rows") == 0, "none").otherwise("several")))
    one = df.limit(2).agg(rows.alias("_rows"))
    # assert_true gives null; the row is kept through its value so that the check is not pruned
    return (one.select(F.coalesce(ok.cast("boolean"), F.lit(True)).alias("_ok"), "_rows").where("_ok")
            .select(F.inline("_rows")))


# --------------------------------------------------------------------------
# B: filters and projections
# --------------------------------------------------------------------------

def eq_filter(df: DataFrame, filters: dict) -> DataFrame:
    """B2: AND of equalities; camelCase keys converted; None values skipped."""
    conds = [F.col(to_snake(k)) == F.lit(v) for k, v in filters.items() if v is not None]
    return df if not conds else df.where(reduce(lambda a, b: a & b, conds))


def parsed_date(col: str | Column = "date") -> Column:
    """The DD/MM/YYYY text as a DATE; free tokens and blanks give NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_date(c, DATE_FMT)


def newest_first(df: DataFrame) -> DataFrame:
    """``created_at`` descending, id as tie-break (a range-partitioned sort)."""
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc())


def task_list(tasks: DataFrame, *, user_id: str | None = None, project_id: str | None = None,
              archived: bool | None = None, priority: str | None = None,
              date_filter: str | None = None, as_of=None, order: bool = True) -> DataFrame:
    """The server-side task list with its optional filters, newest first.

    ``date_filter``: 'TODAY' = date text equals as_of as DD/MM/YYYY;
    'NEXT_7' = parsed due date on or before as_of + 7 days (the text
    comparison of the reference is replaced by a date comparison).
    """
    t = tasks if user_id is None else tasks.where(F.col("user_id") == user_id)
    if project_id and project_id != "INBOX":
        t = t.where(F.col("project_id") == project_id)
    if archived is not None:
        t = t.where(F.col("archived") == F.lit(archived))
    if priority:
        t = t.where(F.col("priority") == priority)
    now = ts_lit(as_of)
    if date_filter == "TODAY":
        t = t.where(F.col("date") == F.date_format(now, DATE_FMT))
    elif date_filter == "NEXT_7":
        t = t.where(parsed_date() <= F.date_add(F.to_date(now), 7))
    return newest_first(t) if order else t


def today_tasks(tasks: DataFrame, *, as_of=None, user_id: str | None = None) -> DataFrame:
    """Active tasks due today (date text = as_of as DD/MM/YYYY)."""
    return task_list(tasks, user_id=user_id, archived=False, date_filter="TODAY", as_of=as_of, order=False)


def next7_tasks(tasks: DataFrame, *, as_of=None, user_id: str | None = None,
                exclude_today: bool = False) -> DataFrame:
    """Active tasks with a parsed due date in [today, today + 7] inclusive.

    ``exclude_today=True`` keeps the hook's rule: the due date (midnight) must
    not be before the as_of instant, so today only counts at exactly midnight.
    """
    now = ts_lit(as_of)
    t = tasks if user_id is None else tasks.where(F.col("user_id") == user_id)
    d = parsed_date()
    t = t.where(F.col("archived") == F.lit(False))
    if exclude_today:
        ts = d.cast("timestamp_ntz")
        return t.where((ts >= now) & (ts <= now + F.make_dt_interval(F.lit(7))))
    today = F.to_date(now)
    return t.where((d >= today) & (d <= F.date_add(today, 7)))


def inbox_tasks(tasks: DataFrame, *, user_id: str | None = None) -> DataFrame:
    """Project '1', active, no due date (NULL or empty)."""
    t = tasks if user_id is None else tasks.where(F.col("user_id") == user_id)
    return t.where((F.col("project_id") == "1") & (F.col("archived") == F.lit(False))
                   & (F.col("date").isNull() | (F.col("date") == "")))


def project_tasks(tasks: DataFrame, selected: str, *, as_of=None, user_id: str | None = None) -> DataFrame:
    """The list of the selected sidebar entry (virtual list or real project)."""
    if selected == "INBOX":
        return inbox_tasks(tasks, user_id=user_id)
    if selected == "TODAY":
        return today_tasks(tasks, as_of=as_of, user_id=user_id)
    if selected == "NEXT_7":
        return next7_tasks(tasks, as_of=as_of, user_id=user_id)
    return task_list(tasks, user_id=user_id, project_id=selected, archived=False, order=False)


def active_archived_split(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, archived) result sets."""
    a = F.col("archived") == F.lit(True)
    return tasks.where(~a), tasks.where(a)


def active_archived_counts(tasks: DataFrame) -> DataFrame:
    """B7 counted: per user the size of both lists."""
    return tasks.groupBy("user_id", "archived").agg(F.count("*").alias("n_tasks"))


def project_projection(projects: DataFrame) -> DataFrame:
    """Projects with the client's alias columns and a zero task count."""
    return projects.select(
        "*", F.col("id").alias("docId"), F.col("id").alias("projectId"),
        F.lit(0).cast("long").alias("taskCount"), F.col("user_id").alias("userId"),
        F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"))


def word_count(text: Column) -> Column:
    """Number of non-empty pieces of the JS-trimmed text split on whitespace."""
    from tidemark.functions.text import JS_WS
    pieces = F.split(js_trim(text), f"{JS_WS}+")
    return F.size(F.filter(pieces, lambda w: F.length(w) > 0))


def parse_eligible(df: DataFrame, text_col: str = "task") -> DataFrame:
    """Text worth parsing: raw length > 8 and at least 2 words after trim."""
    t = F.col(text_col)
    return df.where((F.length(t) > 8) & (word_count(t) >= 2))


def valid_messages(conv: DataFrame) -> DataFrame:
    """Messages must have a role and non-empty content."""
    return conv.where(F.col("role").isNotNull() & (F.col("role") != "")
                      & F.col("text").isNotNull() & (F.col("text") != ""))


def metadata_fields(df: DataFrame, col: str = "metadata") -> DataFrame:
    """aiParsed.category, aiParsed.people joined with ', ', subtask flag."""
    people = F.from_json(F.get_json_object(col, "$.aiParsed.people"), "array<string>")
    return df.select(
        "id",
        F.get_json_object(col, "$.aiParsed.category").alias("category"),
        F.when(F.size(people) > 0, F.array_join(people, ", ")).alias("people"),
        F.coalesce(F.get_json_object(col, "$.type") == "subtask", F.lit(False)).alias("is_subtask"))


def editable_text(edits: DataFrame, text_col: str = "new_text") -> DataFrame:
    """Keep edits whose trimmed text is non-empty; store it trimmed."""
    trimmed = js_trim(F.col(text_col))
    return (edits.withColumn(text_col, trimmed).where(F.length(F.col(text_col)) > 0))


# --------------------------------------------------------------------------
# E, F: top-n lists and orderings
# --------------------------------------------------------------------------

def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in ``order`` with their rank (1-based)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= n)


def last_messages(conv: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` messages of each conversation (``pos`` 1 = oldest kept)."""
    last = top_n(conv, ["conv_id"], [F.col("turn").desc()], n, "_from_end")
    return last.withColumn("pos", F.lit(n + 1) - F.col("_from_end")).drop("_from_end")


def context_tasks(tasks: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` tasks of each user in list order (newest first), 6 columns."""
    first = top_n(tasks, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], n, "list_pos")
    return first.select("user_id", "list_pos", "id", "task", "priority", "date",
                        F.col("project_id").alias("projectId"), "archived")


def projects_ordered(projects: DataFrame, by: str = "id") -> DataFrame:
    """projects by ``id`` (older client) or by ``created_at`` ascending."""
    return projects.orderBy(F.col(by).asc(), F.col("id").asc())


def ordered_list_long(df: DataFrame, keys: list[str], order_cols: list[str],
                      value_cols: list[str]) -> DataFrame:
    """F4 long form: the ordered per-group list as (keys, pos, values).

    The nested form is ``sort_array(collect_list(struct(order..., values...)))``;
    groups here are per-user day lists, bounded by the report window.
    """
    packed = (df.groupBy(*keys)
              .agg(F.sort_array(F.collect_list(F.struct(*order_cols, *value_cols))).alias("_l")))
    return packed.select(*keys, F.posexplode("_l").alias("pos", "_e")).select(
        *keys, (F.col("pos") + 1).cast("long").alias("pos"), *[F.col("_e." + c).alias(c) for c in order_cols + value_cols])
