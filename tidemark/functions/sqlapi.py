"""Search and reports as SQL functions of a session (§2.11).

* ``search_tasks(user, query)``, a table function: the rows of I5 + F3 for one user;
* ``get_user_analytics(user)`` and ``get_productivity_insights(user)``, JSON texts (D7, D14).

They are SQL functions, so a call becomes part of the caller's plan: the user's
id reaches the scans, and called with LATERAL for many users the search is one
join on the user. Nothing is computed when they are created.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import search as S
from tidemark.operators.joins import UNKNOWN_PROJECT


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stem(w: str) -> str:
    """search.stem() of the SQL expression ``w``."""
    ends = lambda s: f"endswith({w}, '{s}')"
    cut = lambda n: f"substr({w}, 1, length({w}) - {n})"
    return (f"CASE WHEN {ends('ies')} AND NOT {ends('eies')} AND NOT {ends('aies')} THEN {cut(3)} || 'y' "
            f"WHEN {ends('es')} AND NOT {ends('aes')} AND NOT {ends('ees')} AND NOT {ends('oes')} THEN {cut(1)} "
            f"WHEN {ends('s')} AND NOT {ends('us')} AND NOT {ends('ss')} THEN {cut(1)} ELSE {w} END")


def _terms(q: str) -> str:
    """Distinct normalised terms of the query text ``q``, as search.query_terms()."""
    stops = ", ".join(_text(w) for w in S.STOP_WORDS)
    return (f"array_distinct(transform(filter(regexp_extract_all(lower({q}), {_text(S.TOKEN_RE)}, 0), "
            f"w -> NOT array_contains(array({stops}), w)), w -> {_stem('w')}))")


def _rank(hits: str) -> str:
    """SELECT of every column of ``hits(n_terms, occs, ...)`` and ``relevance_score``, as search.rank_expr()."""
    weight = f"{S.WEIGHT * S.WEIGHT!r}D"
    near = f"o.lexeme <> occs[i - 1].lexeme AND o.pos - occs[i - 1].pos <= {S.MAX_DIST}"
    log = f"log1p(-sqrt({weight} * (1.0D / (1.005D + 0.05D * exp(CAST(o.pos - occs[i - 1].pos AS DOUBLE) / 1.5D - 2.0D)))))"
    far = f"{math.log1p(-math.sqrt(S.WEIGHT * S.WEIGHT * S.FAR_WEIGHT))!r}D"
    single = (f"{S.WEIGHT!r}D * aggregate(sequence(1, size(occs)), 0.0D, (a, k) -> a + 1.0D / CAST(k * k AS DOUBLE)) "
              f"/ {S.ZETA2!r}D")
    return f"""SELECT *, CAST(CASE WHEN coalesce(r, 0.0D) <= 0 THEN {S.EMPTY_RANK!r}D ELSE r END AS FLOAT) AS relevance_score
  FROM (SELECT *, CASE WHEN n_terms = 1 THEN one ELSE -expm1(near.log + (pairs - near.pairs) * {far}) END AS r FROM (
    SELECT *, {single} AS one,
      aggregate(sequence(1, size(occs)), named_struct('log', 0.0D, 'pairs', 0L), (acc, i) -> named_struct(
        'log', acc.log + aggregate(filter(slice(occs, i + 1, {S.MAX_DIST}), o -> {near}), 0.0D, (a, o) -> a + {log}),
        'pairs', acc.pairs + size(filter(slice(occs, i + 1, {S.MAX_DIST}), o -> {near})))) AS near,
      (CAST(size(occs) AS BIGINT) * size(occs) - aggregate(array_distinct(occs.lexeme), 0L, (a, x) -> a
        + CAST(pow(size(filter(occs.lexeme, y -> y = x)), 2) AS BIGINT))) / 2 AS pairs
    FROM ({hits})))"""


def _search(k: int) -> str:
    # the parameters stand in filters and projections only: there a call with LATERAL becomes joins on user and lexeme
    terms = f"""SELECT who, n_terms, term FROM (SELECT who, size(terms) AS n_terms, terms
        FROM (SELECT p_user_id AS who, {_terms('search_query')} AS terms))
      LATERAL VIEW explode(terms) e AS term"""
    found = f"""SELECT d.id, max(q.n_terms) AS n_terms, count(*) AS n_found, sort_array(flatten(collect_list(
        transform(d.positions, x -> named_struct('pos', x, 'lexeme', d.lexeme))))) AS occs
      FROM (SELECT * FROM task_postings WHERE user_id = p_user_id) d
      JOIN ({terms}) q ON d.user_id = q.who AND d.lexeme = q.term GROUP BY d.id"""
    hits = f"""SELECT h.n_terms, h.occs, t.id, t.task, t.project_id, t.priority, t.created_at FROM ({found}) h
      JOIN (SELECT * FROM tasks WHERE user_id = p_user_id AND archived = false) t ON t.id = h.id
      WHERE h.n_found = h.n_terms"""
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION search_tasks(p_user_id STRING, search_query STRING)
RETURNS TABLE(id BIGINT, task STRING, project_name STRING, priority STRING, created_at TIMESTAMP_NTZ, relevance_score FLOAT)
RETURN SELECT r.id, r.task, coalesce(p.name, {_text(UNKNOWN_PROJECT)}) AS project_name, r.priority, r.created_at,
    r.relevance_score
  FROM ({_rank(hits)}) r LEFT JOIN projects p ON p.id = r.project_id
  ORDER BY relevance_score DESC, created_at DESC, id DESC LIMIT {int(k)}"""


def register_search(spark: SparkSession, tasks: DataFrame, projects: DataFrame, postings: DataFrame | None = None,
                    k: int = 50) -> None:
    """Create the views ``tasks``, ``projects``, ``task_postings`` and the function ``search_tasks``.

    ``postings`` are stored ones (``search.store_postings`` or the stream J7); without them the tasks are tokenised
    per call. A user without tasks, a null user and a null query find nothing.
    """
    tasks.createOrReplaceTempView("tasks")
    projects.createOrReplaceTempView("projects")
    postings = S.search_postings(tasks) if postings is None else postings
    (postings.select("user_id", "id", "lexeme", F.col("positions").cast("array<int>").alias("positions"))
     .createOrReplaceTempView("task_postings"))
    spark.sql(_search(k))


def register_reports(spark: SparkSession, tasks: DataFrame, projects: DataFrame, *, as_of=None, days_back: int = 30) -> None:
    """Create ``get_user_analytics`` and ``get_productivity_insights``.

    ``as_of`` and ``days_back`` hold for all calls: the reports' windows are part of their views.
    A user without tasks and a null user have a null report.
    """
    reports = {"get_user_analytics": A.user_analytics(tasks, projects, as_of=as_of),
               "get_productivity_insights": A.productivity_insights(tasks, projects, as_of=as_of, days_back=days_back)}
    for name, df in reports.items():
        body = F.struct(*[c for c in df.columns if c != "user_id"])
        df.select("user_id", F.to_json(body).alias("report")).createOrReplaceTempView(f"{name}_reports")
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(p_user_id STRING) RETURNS STRING
RETURN SELECT max(report) FROM {name}_reports WHERE user_id = p_user_id""")
