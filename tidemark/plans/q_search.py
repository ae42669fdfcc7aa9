"""Registered search queries (I1-I5, F3): each user runs one query over their tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sqlapi
from tidemark.operators import search as S
from tidemark.plans.oracle_views import with_views
from tidemark.plans.registry import register
from tidemark.sources.tables import dealt, load_views
from tidemark.streaming.feeds import scratch_path

# Query texts for the fixture users (user uN runs QUERY_POOL[N % 8]); one of
# them is only stop words and must match nothing.
QUERY_POOL = ["small rings", "Buy bolt", "meeting review", "the and", "gear widgets", "urgent fixes",
              "blue", "research plans"]


def user_queries(tasks):
    n = F.col("user_id").substr(F.lit(2), F.lit(10)).cast("int")
    pool = F.array(*[F.lit(x) for x in QUERY_POOL])
    return tasks.select("user_id").distinct().select(
        "user_id", F.element_at(pool, (n % len(QUERY_POOL)).cast("int") + 1).alias("query"))


def q(s):
    return "'" + s.replace("'", "''") + "'"


STOPS = "[" + ", ".join(q(s) for s in S.STOP_WORDS) + "]"


def d_stem(w):
    return (f"case when {w} like '%ies' and not {w} like '%eies' and not {w} like '%aies' "
            f"then substr({w}, 1, length({w}) - 3) || 'y' "
            f"when {w} like '%es' and not {w} like '%aes' and not {w} like '%ees' and not {w} like '%oes' "
            f"then substr({w}, 1, length({w}) - 1) "
            f"when {w} like '%s' and not {w} like '%us' and not {w} like '%ss' "
            f"then substr({w}, 1, length({w}) - 1) else {w} end")


SEARCH_CTES = [
    "uq as (select user_id, list_extract([" + ", ".join(q(x) for x in QUERY_POOL) + "], "
    f"cast(substr(user_id, 2) as int) % {len(QUERY_POOL)} + 1) as query from (select distinct user_id from tasks) u)",
    """docs as (select user_id, id, archived, created_at, project_id, priority, task,
       regexp_extract_all(lower(concat_ws(' ', coalesce(task, ''),
         coalesce(json_extract_string(metadata, '$.category'), ''),
         coalesce(json_extract(metadata, '$.tags')::varchar, ''))), '[\\p{L}\\p{N}]+') as toks from tasks)""",
    f"""toks as (select user_id, id, archived, pos, {d_stem('tok')} as lexeme from (
       select user_id, id, archived, unnest(toks) as tok, generate_subscripts(toks, 1) as pos from docs) x
       where not list_contains({STOPS}, tok))""",
    f"""qterms as (select distinct user_id, {d_stem('tok')} as lexeme from (
       select user_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) as tok from uq) x
       where not list_contains({STOPS}, tok))""",
    "nq as (select user_id, count(*) as n_terms from qterms group by user_id)",
]
MATCH_CTE = """matched as (select t.user_id, t.id, n.n_terms from toks t join qterms q on q.user_id = t.user_id
       and q.lexeme = t.lexeme join nq n on n.user_id = t.user_id {where}
       group by t.user_id, t.id, n.n_terms having count(distinct t.lexeme) = n.n_terms)"""
RANK_CTES = [
    """occ as (select t.user_id, t.id, t.lexeme, t.pos, m.n_terms from toks t
       join matched m on m.user_id = t.user_id and m.id = t.id
       join qterms q on q.user_id = t.user_id and q.lexeme = t.lexeme)""",
    """single as (select user_id, id, 0.1::double * list_sum(list_transform(range(1, count(*) + 1),
         lambda k: 1.0::double / (k * k)::double)) / 1.64493406685::double as r
       from occ where n_terms = 1 group by user_id, id)""",
    # a far pair keeps 1 - 1e-16; 1 - exp(s) as a series where s is too small for the difference
    """multi as (select user_id, id, case when s > -1e-6 then -s * (1 + s / 2) else 1.0::double - exp(s) end as r
       from (select a.user_id, a.id, sum(case when abs(a.pos - b.pos) > 100 then -1e-16::double
           else ln(1.0::double - sqrt(0.01::double * (1.0::double / (1.005::double + 0.05::double
             * exp(abs(a.pos - b.pos)::double / 1.5::double - 2.0::double))))) end) as s
       from occ a join occ b on a.user_id = b.user_id and a.id = b.id and a.lexeme < b.lexeme
       where a.n_terms > 1 group by a.user_id, a.id) x)""",
    """ranked as (select m.user_id, m.id, cast(case when coalesce(s.r, mu.r, 1e-20) <= 0 then 1e-20
         else coalesce(s.r, mu.r, 1e-20) end as float) as relevance_score
       from matched m left join single s on s.user_id = m.user_id and s.id = m.id
       left join multi mu on mu.user_id = m.user_id and mu.id = m.id)""",
]


def _ctes(active: bool):
    where = "where t.archived = false" if active else ""
    toks_filter = SEARCH_CTES[:]
    if active:
        toks_filter[2] = toks_filter[2].replace("where not list_contains", "where archived = false and not list_contains")
    return toks_filter + [MATCH_CTE.format(where="")] + RANK_CTES if not active else \
        toks_filter + [MATCH_CTE.format(where=where)] + RANK_CTES


@register("search_postings", with_views("""
select user_id, id, lexeme, array_to_string(list_sort(list(pos)), ',') as positions
from toks group by user_id, id, lexeme""", *SEARCH_CTES[:3]))
def q_search_postings(spark, sf):
    t, _ = load_views(spark, sf)
    p = S.search_postings(dealt(t))
    return p.select("user_id", "id", "lexeme", F.array_join("positions", ",").alias("positions"))


@register("search_query_terms", with_views("select user_id, lexeme from qterms", *SEARCH_CTES))
def q_search_query_terms(spark, sf):
    t, _ = load_views(spark, sf)
    return S.query_terms(user_queries(t))


@register("search_match", with_views("select user_id, id, n_terms from matched", *_ctes(False)[:6]))
def q_search_match(spark, sf):
    t, _ = load_views(spark, sf)
    return S.search_match(dealt(t), user_queries(t))


@register("search_rank", with_views("select user_id, id, relevance_score from ranked", *_ctes(False)))
def q_search_rank(spark, sf):
    t, _ = load_views(spark, sf)
    return S.search_rank(dealt(t), user_queries(t))


_TOP = """select * from (
  select r.user_id, row_number() over (partition by r.user_id order by r.relevance_score desc, d.created_at desc,
           d.id desc) as result_pos,
         d.id, d.task, coalesce(p.name, 'Unknown Project') as project_name, d.priority, d.created_at, r.relevance_score
  from ranked r join docs d on d.user_id = r.user_id and d.id = r.id
  left join projects p on p.id = d.project_id) x where result_pos <= 50"""


@register("search_tasks", with_views(_TOP, *_ctes(True)))
def q_search_tasks(spark, sf):
    t, p = load_views(spark, sf)
    return S.search_tasks(dealt(t), p, user_queries(t), k=50)


@register("search_stored", with_views(_TOP, *_ctes(True)))
def q_search_stored(spark, sf):
    t, p = load_views(spark, sf)
    stored = S.store_postings(S.search_postings(dealt(t)), f"{scratch_path(spark, 'postings')}/by-lexeme")
    return S.search_stored(stored, t, p, user_queries(t), k=50)


@register("search_top50", with_views("select user_id, result_pos, id from (" + _TOP + ") y", *_ctes(True)))
def q_search_top50(spark, sf):
    t, p = load_views(spark, sf)
    return S.search_tasks(dealt(t), p, user_queries(t), k=50).select("user_id", "result_pos", "id")


@register("search_function", with_views("select user_id, id, task, project_name, priority, created_at, relevance_score from ("
                                        + _TOP + ") y", *_ctes(True)))
def q_search_function(spark, sf):
    """The SQL table function, called for every user's query."""
    t, p = load_views(spark, sf)
    sqlapi.register_search(spark, dealt(t), p)
    return spark.sql("SELECT u.user_id, s.* FROM {queries} u, LATERAL search_tasks(u.user_id, u.query) s",
                     queries=user_queries(t))
