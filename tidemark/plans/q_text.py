"""Registered text-rule queries (H1-H26) and their DuckDB oracles.

The oracle expressions are written in DuckDB's dialect from the same rule
tables (``tidemark.functions.rules``); the unit tests pin hand-computed
edge cases, so a mistake shared by both sides cannot hide.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import enrich as E
from tidemark.functions import rules as R
from tidemark.functions.text import JS_WS, TRIM_RE
from tidemark.operators import lists as L
from tidemark.operators import textrules as X
from tidemark.plans.oracle_views import ANSWERS_SQL, CONTEXT_SQL, with_texts
from tidemark.plans.registry import register
from tidemark.sources.tables import dealt, load_views, parsed_answers, read_table, rule_texts


# ---------------------------------------------------------------------------
# DuckDB expression builders
# ---------------------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::varchar[]"


def d_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(TRIM_RE)}, '', 'g')"


def d_collapse(x: str) -> str:
    return f"regexp_replace({x}, {q(JS_WS + '+')}, ' ', 'g')"


def d_replace_first(t: str, n: str) -> str:
    return (f"(case when {n} is not null and instr({t}, {n}) > 0 then "
            f"substr({t}, 1, instr({t}, {n}) - 1) || substr({t}, instr({t}, {n}) + length({n})) else {t} end)")


def d_any(low: str, words) -> str:
    return "(" + " or ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def d_first(x: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {q(p)}, 0), '')" for p in patterns) + ")"


def d_date(x):
    return d_first(x, R.DATE_PATTERNS)


def d_time(x):
    return d_first(x, R.TIME_PATTERNS)


def d_priority(x):
    return (f"(case when regexp_matches({x}, {q(R.PRIORITY_HIGH_PATTERN)}) then 'high' "
            f"when regexp_matches({x}, {q(R.PRIORITY_LOW_PATTERN)}) then 'low' else 'medium' end)")


def d_people(x):
    parts = ", ".join(f"regexp_extract({x}, {q(p)}, 1)" for p in R.PEOPLE_PATTERNS)
    return f"list_filter([{parts}], lambda v: v <> '')"


def d_table(low: str, table, default: str) -> str:
    arms = " ".join(f"when {d_any(low, words)} then {q(val)}" for val, words in table)
    return f"(case {arms} else {q(default)} end)"


def d_category(x):
    return d_table(f"lower({x})", R.CATEGORY_KEYWORDS, R.DEFAULT_CATEGORY)


def d_duration(x):
    return d_table(f"lower({x})", R.DURATION_KEYWORDS, R.DEFAULT_DURATION)


def d_tags(x):
    low = f"lower({x})"
    parts = ", ".join(f"case when {d_any(low, words)} then {q(tag)} end" for tag, words in R.SMART_TAGS)
    return f"list_filter([{parts}], lambda v: v is not null)"


def d_suggestions(name: str, cat: str) -> str:
    low = f"lower({name})"
    arms = " ".join(f"when {d_any(low, words)} then {d_list(sug)}" for words, sug in R.SUGGESTION_RULES)
    arms += " " + " ".join(f"when {cat} = {q(c)} then {d_list(sug)}" for c, sug in R.CATEGORY_FALLBACK_SUGGESTIONS)
    return f"(case {arms} else {d_list(R.GENERIC_SUGGESTIONS)} end)"


def d_clean_ctes(src: str, x: str, key: str, out: str, prefix: str) -> tuple[list[str], str]:
    """CTEs computing the cleaned name step by step; returns (ctes, last cte name)."""
    needles = [d_date(x), d_time(x)] + [f"nullif(regexp_extract({x}, {q(p)}, 0), '')" for p in R.PEOPLE_PATTERNS]
    ctes = [f"{prefix}0 as (select *, " + ", ".join(f"{n} as m{i}" for i, n in enumerate(needles))
            + f", {x} as s from {src})"]
    for i in range(len(needles)):
        ctes.append(f"{prefix}{i + 1} as (select * replace (case when m{i} is not null then "
                    f"{d_trim(d_replace_first('s', f'm{i}'))} else s end as s) from {prefix}{i})")
    last = f"{prefix}{len(needles) + 1}"
    ctes.append(f"{last} as (select *, regexp_replace({d_trim(d_collapse('s'))}, {q(R.LEADING_VERB_PATTERN)}, '')"
                f" as {out} from {prefix}{len(needles)})")
    return ctes, last


def d_confidence(x, date, time, people):
    c = f"{R.CONFIDENCE_BASE}::double"
    c = f"(case when {date} is not null then {c} + {R.CONFIDENCE_DATE}::double else {c} end)"
    c = f"(case when {time} is not null then {c} + {R.CONFIDENCE_TIME}::double else {c} end)"
    c = f"(case when len({people}) > 0 then {c} + {R.CONFIDENCE_PEOPLE}::double else {c} end)"
    c = f"(case when length({x}) > {R.CONFIDENCE_LONG_OVER} then {c} + {R.CONFIDENCE_LONG}::double else {c} end)"
    return f"least({c}, 1.0::double)"


def parse_cte(src: str, text: str = "task", key: str = "id") -> str:
    """CTE ``parsed``: the smart-parse fields for each row of ``src``."""
    t = "t"
    quick_arms = []
    for prefix, cat, tags, prio, dur in R.QUICK_PREFIXES:
        quick_arms.append((f"starts_with(lower({t}), {q(prefix)})", prefix, cat, tags, prio, dur))

    def quick_field(fn, default):
        arms = " ".join(f"when {cond} then {fn(prefix, cat, tags, prio, dur)}"
                        for cond, prefix, cat, tags, prio, dur in quick_arms)
        return f"(case {arms} else {default} end)"

    rest = lambda prefix: d_trim(f"substr({t}, {len(prefix) + 1})")
    quick_hit = "(" + " or ".join(c for c, *_ in quick_arms) + ")"
    rule_name = "rn"
    fields = {
        "task_name": (quick_field(lambda p, c, tg, pr, du: f"coalesce(nullif({rest(p)}, ''), {t})", "null"),
                      f"coalesce(nullif({rule_name}, ''), {t})"),
        "date": ("null", "dt"),
        "time": ("null", "tm"),
        "priority": (quick_field(lambda p, c, tg, pr, du: q(pr or 'medium'), "null"), d_priority(t)),
        "people": ("''", "array_to_string(pp, ', ')"),
        "category": (quick_field(lambda p, c, tg, pr, du: q(c or R.DEFAULT_CATEGORY), "null"), "cat"),
        "tags": (quick_field(lambda p, c, tg, pr, du: q(",".join(tg)), "null"), f"array_to_string({d_tags(t)}, ',')"),
        "estimated_duration": (quick_field(lambda p, c, tg, pr, du: q(du or R.DEFAULT_DURATION), "null"),
                               d_duration(t)),
        "suggestions": (quick_field(lambda p, c, tg, pr, du: f"array_to_string({d_suggestions(rest(p), q(c) if c else 'null')}, ' | ')", "null"),
                        f"array_to_string({d_suggestions(rule_name, 'cat')}, ' | ')"),
        "confidence": (f"{R.QUICK_CONFIDENCE}::double", d_confidence(t, "dt", "tm", "pp")),
        "fast_response": ("true", "false"),
    }
    sel = ",\n       ".join(f"case when {quick_hit} then {a} else {b} end as {name}" for name, (a, b) in fields.items())
    clean, last = d_clean_ctes("base0", "t", key, "rn", "cln")
    return ",\n".join([f"base0 as (select {key}, {d_trim(text)} as t from {src})"] + clean + [
        f"""base1 as (select *, {d_date('t')} as dt, {d_time('t')} as tm, {d_people('t')} as pp,
                 {d_category('t')} as cat from {last})""",
        f"""parsed as (select {key}, {sel}
from base1)"""])


def d_breakdown_key(x):
    low = f"lower({x})"
    arms = " ".join(f"when contains({low}, {q(k)}) or contains({q(k)}, {low}) then {q(k)}"
                    for k, _ in R.BREAKDOWN_TEMPLATES)
    return f"(case {arms} end)"


def d_steps_values():
    rows = []
    for k, steps in R.BREAKDOWN_TEMPLATES:
        for i, (task, prio, est) in enumerate(steps, 1):
            rows.append(f"({q(k)}, {i}, {q(task)}, {q(prio)}, {q(est)})")
    return "values " + ", ".join(rows)


def d_priority_pairs(low):
    pairs = [(lv, w) for lv, words in R.PRIORITY_KEYWORDS for w in words]
    prio = " ".join(f"when contains({low}, {q(w)}) then {q(lv)}" for lv, w in pairs)
    why = " ".join(f"when contains({low}, {q(w)}) then {q(R.PRIORITY_REASON_FORMAT % (lv, w))}" for lv, w in pairs)
    return f"(case {prio} else 'medium' end)", f"(case {why} else {q(R.PRIORITY_REASON_DEFAULT)} end)"


def d_topic(x):
    low = f"lower({x})"
    arms = " ".join(f"when contains({low}, {q(tp)}) then {q(tp)}" for tp, _ in R.TOPIC_SUGGESTIONS)
    return f"(case {arms} end)"


def d_choice(x, rules, default):
    low = f"lower({x})"
    arms = " ".join(f"when {d_any(low, words)} then {q(v)}" for words, v in rules)
    return f"(case {arms} else {q(default)} end)"


# ---------------------------------------------------------------------------
# registered queries (input: the derived tasks' text)
# ---------------------------------------------------------------------------

def _tasks(spark, sf):
    t, _ = load_views(spark, sf)
    return dealt(rule_texts(t))


def _single(name: str, spark_expr, sql_expr: str, trim: bool = True):
    """Register a one-column enrichment over tasks.task."""
    body = f"select id, {sql_expr.replace('__T__', d_trim('task') if trim else 'task')} as {name} from tasks"

    @register(name, with_texts(body))
    def build(spark, sf):
        t = _tasks(spark, sf)
        x = E.js_trim(F.col("task")) if trim else F.col("task")
        return t.select("id", spark_expr(x).alias(name))
    return build



_single("extract_date", E.extract_date, d_date("__T__"))
_single("extract_time", E.extract_time, d_time("__T__"))
_single("extract_priority", E.extract_priority, d_priority("__T__"))
_single("extract_people", lambda c: F.array_join(E.extract_people(c), ", "),
        "array_to_string(" + d_people("__T__") + ", ', ')")
_single("infer_category", E.infer_category, d_category("__T__"))
_single("smart_tags", lambda c: F.array_join(E.smart_tags(c), ","), "array_to_string(" + d_tags("__T__") + ", ',')")
_single("estimate_duration", E.estimate_duration, d_duration("__T__"))


_SUG_CTES, _SUG_LAST = d_clean_ctes("tt", "t", "id", "rn", "cln")


@register("task_suggestions", with_texts(f"""
select id, array_to_string({d_suggestions('rn', d_category('t'))}, ' | ') as suggestions from {_SUG_LAST}""",
    f"tt as (select id, {d_trim('task')} as t from tasks)", *_SUG_CTES))
def q_task_suggestions(spark, sf):
    t = _tasks(spark, sf).select("id", E.js_trim(F.col("task")).alias("t"))
    c = E.with_clean_name(t, "t", "name")
    return c.select("id", F.array_join(E.task_suggestions(F.col("name"), E.infer_category(F.col("t"))), " | ")
                    .alias("suggestions"))


@register("parse_confidence", with_texts(f"""
select id, {d_confidence('t', d_date('t'), d_time('t'), d_people('t'))} as confidence
from (select id, {d_trim('task')} as t from tasks) a"""))
def q_parse_confidence(spark, sf):
    t = _tasks(spark, sf)
    x = E.js_trim(F.col("task"))
    return t.select("id", E.parse_confidence(x, E.extract_date(x), E.extract_time(x), E.extract_people(x))
                    .alias("confidence"))


@register("quick_parse", with_texts("""
select id, task_name, priority, category, tags, estimated_duration, suggestions, confidence
from parsed where fast_response""", parse_cte("tasks")))
def q_quick_parse(spark, sf):
    t = _tasks(spark, sf)
    quick = t.where(E.quick_rule_index(E.js_trim(F.col("task"))).isNotNull())
    flat = X.smart_parse_flat(quick)
    return flat.select("id", "task_name", "priority", "category", "tags",
                                              "estimated_duration", "suggestions", "confidence")


@register("smart_parse", with_texts("select * from parsed", parse_cte("tasks")))
def q_smart_parse(spark, sf):
    return X.smart_parse_flat(_tasks(spark, sf))


@register("parse_defaults", f"""
select event_id, coalesce(nullif(json_extract_string(props, '$.taskName'), ''), props) as task_name,
       coalesce(nullif(json_extract_string(props, '$.priority'), ''), 'medium') as priority,
       coalesce(nullif(json_extract_string(props, '$.category'), ''), {q(R.DEFAULT_CATEGORY)}) as category,
       coalesce(nullif(json_extract_string(props, '$.estimatedDuration'), ''), {q(R.DEFAULT_DURATION)}) as estimated_duration,
       coalesce(nullif(cast(json_extract(props, '$.confidence') as double), 0.0), {R.CONFIDENCE_BASE}::double) as confidence
from ({ANSWERS_SQL}) answers""")
def q_parse_defaults(spark, sf):
    ev = parsed_answers(read_table(spark, sf, "events"))
    schema = ("taskName string, date string, time string, priority string, people array<string>, "
              "category string, tags array<string>, estimatedDuration string, suggestions array<string>, "
              "confidence double")
    p = E.parse_defaults(F.from_json("props", schema), F.col("props"))
    return ev.select("event_id", p.taskName.alias("task_name"), p.priority.alias("priority"),
                     p.category.alias("category"), p.estimatedDuration.alias("estimated_duration"),
                     p.confidence.alias("confidence"))


BREAKDOWN_SQL = f"""
select b.id, s.step, s.task, s.priority, s.estimated_time,
       case when len(tv.steps) > {R.TOTAL_TIME_STEPS_OVER} then {q(R.TOTAL_TIME_LONG)} else {q(R.TOTAL_TIME_SHORT)} end
         as total_estimated_time, null::varchar as suggestion
from bk b join tmpl s on s.key = b.key
join (select key, list(step) as steps from tmpl group by key) tv on tv.key = b.key
union all
select b.id, g.step, g.prefix || b.t, g.priority, g.estimated_time, null, {q(R.GENERIC_BREAKDOWN_NOTE)}
from bk b, (values {", ".join(f"({i}, {q(pre)}, {q(p)}, {q(e)})" for i, (pre, p, e) in enumerate(R.GENERIC_BREAKDOWN, 1))})
  g(step, prefix, priority, estimated_time)
where b.key is null"""


@register("task_breakdown", with_texts(BREAKDOWN_SQL,
          f"bk as (select id, t, {d_breakdown_key('t')} as key from (select id, {d_trim('task')} as t from tasks) a)",
          f"tmpl(key, step, task, priority, estimated_time) as ({d_steps_values()})"))
def q_task_breakdown(spark, sf):
    return X.breakdown(_tasks(spark, sf))


@register("breakdown_total_time", with_texts(f"""
select id, case when {d_breakdown_key('t')} is not null then {q(R.TOTAL_TIME_LONG)} end as total_estimated_time
from (select id, {d_trim('task')} as t from tasks) a"""))
def q_breakdown_total_time(spark, sf):
    t = _tasks(spark, sf)
    return t.select("id", E.breakdown_total_time(E.js_trim(F.col("task"))).alias("total_estimated_time"))


_PRIO, _WHY = d_priority_pairs("lower(coalesce(task, ''))")


@register("smart_prioritize", with_texts(f"select id, user_id, {_PRIO} as ai_priority, {_WHY} as reasoning from tasks"))
def q_smart_prioritize(spark, sf):
    return X.prioritize(_tasks(spark, sf)).select("id", "user_id", "ai_priority", "reasoning")


def _topic_values():
    rows = []
    for tp, sug in R.TOPIC_SUGGESTIONS:
        rows += [f"({q(tp)}, {i}, {q(s)})" for i, s in enumerate(sug)]
    rows += [f"(null, {i}, {q(s)})" for i, s in enumerate(R.GENERIC_TOPIC_SUGGESTIONS)]
    return "values " + ", ".join(rows)


@register("contextual_suggestions", with_texts(f"""
select a.id, coalesce(a.topic, {q(R.DEFAULT_CATEGORY)}) as category, 'suggestion' as kind, s.pos, s.text
from a join sug s on s.topic is not distinct from a.topic
union all
select a.id, coalesce(a.topic, {q(R.DEFAULT_CATEGORY)}), 'related_action', r.pos, r.text
from a, (values {", ".join(f"({i}, {q(x)})" for i, x in enumerate(R.RELATED_ACTIONS))}) r(pos, text)""",
          f"a as (select id, {d_topic(d_trim('task'))} as topic from tasks)",
          f"sug(topic, pos, text) as ({_topic_values()})"))
def q_contextual_suggestions(spark, sf):
    return X.suggestions(_tasks(spark, sf))


def _schedule_sql(conflicts: str) -> str:
    t = d_trim("task")
    return f"""select id, {d_choice(t, R.BEST_TIME_RULES, R.BEST_TIME_DEFAULT)} as best_time,
       {d_duration(t)} as duration, {d_choice(t, R.PREP_RULES, R.PREP_DEFAULT)} as preparation,
       {q(' | '.join(R.REMINDERS))} as reminders, {conflicts} as conflicts,
       {q(' | '.join(R.ALTERNATIVES))} as alternatives,
       {d_choice(t, R.BUFFER_RULES, R.BUFFER_DEFAULT)} as buffer_time"""


@register("smart_schedule", with_texts(_schedule_sql(q(R.CONFLICT_FREE)) + " from tasks"))
def q_smart_schedule(spark, sf):
    return X.schedule(_tasks(spark, sf))


@register("schedule_conflicts", with_texts(_schedule_sql(
    f"case when coalesce(c.n, 0) > {R.CONFLICT_OVER} then {q(R.CONFLICT_BUSY)} else {q(R.CONFLICT_FREE)} end")
    + ", tasks.user_id from tasks left join (select user_id, count(*) as n from tasks where archived = false "
      "group by user_id) c on c.user_id = tasks.user_id"))
def q_schedule_conflicts(spark, sf):
    return X.schedule_with_conflicts(_tasks(spark, sf))


@register("suggestions_to_subtasks", with_texts(f"""
select b.id as parent_task_id, s.step - 1 as pos, s.task, coalesce(nullif(b.project_id, ''), '1') as project_id,
       '' as date, s.priority, true as ai_enhanced,
       '{{"parentTask":' || to_json(b.task) || ',"type":"subtask","aiGenerated":true,"estimatedTime":'
         || to_json(s.estimated_time) || '}}' as metadata
from bkp b join ({BREAKDOWN_SQL}) s on s.id = b.id
where (s.step - 1) % 2 = 0""",
          f"bk as (select id, t, {d_breakdown_key('t')} as key from (select id, {d_trim('task')} as t from tasks) a)",
          f"tmpl(key, step, task, priority, estimated_time) as ({d_steps_values()})",
          "bkp as (select id, task, project_id from tasks)"))
def q_suggestions_to_subtasks(spark, sf):
    t = _tasks(spark, sf)
    parents = t.select("id", "task", "project_id", E.breakdown_steps(E.js_trim(F.col("task"))).alias("steps"))
    return X.suggestions_to_subtasks(parents, "steps", selected=(F.col("pos") % 2 == 0))


@register("parsed_to_task", with_texts("""
select p.id, case when t.id % 4 = 0 then t.task else coalesce(nullif(p.task_name, ''), t.task) end as task,
       coalesce(nullif(t.project_id, ''), '1') as project_id,
       case when t.id % 4 = 0 then '' else coalesce(nullif(p.date, ''), '') end as date,
       case when t.id % 4 = 0 then 'medium' else coalesce(nullif(p.priority, ''), 'medium') end as priority,
       t.id % 4 <> 0 as ai_enhanced,
       case when t.id % 4 <> 0 then t.task end as original_input,
       case when t.id % 4 <> 0 then p.confidence end as confidence
from parsed p join tasks t on t.id = p.id""", parse_cte("tasks")))
def q_parsed_to_task(spark, sf):
    t = _tasks(spark, sf).select("id", "task", "project_id")
    p = E.with_smart_parse(t, "task", "_p")
    df = p.select("id", "task", "project_id", F.when(F.col("id") % 4 != 0, F.col("_p")).alias("parsed"))
    return X.parsed_to_task(df)


@register("embedded_json", """
select id, case when json_valid(txt) then 'whole' when json_valid(span) then 'embedded' end as source,
       case when json_valid(txt) then txt when json_valid(span) then span end as json_text
from (select id, txt, nullif(regexp_extract(txt, '(?s)\\{.*\\}', 0), '') as span from (
        select event_id as id, props as txt from events
        union all select page_id + 1000000000, html from pages) u) x""".replace("\\\\", "\\"))
def q_embedded_json(spark, sf):
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("txt"))
    pg = read_table(spark, sf, "pages").select((F.col("page_id") + 1_000_000_000).alias("id"), F.col("html").alias("txt"))
    return X.embedded_json(ev.unionByName(pg), "txt", "id")


@register("task_context_text", with_texts(CONTEXT_SQL))
def q_task_context_text(spark, sf):
    return X.task_context_text(L.context_tasks(_tasks(spark, sf), n=20))


@register("push_id", with_texts(f"""
select id, {" || ".join(f"substr({q(R.PUSH_CHARS)}, cast(((epoch_ms(created_at) >> {6 * k}) & 63) as int) + 1, 1)"
                         for k in range(7, -1, -1))} || {q(R.PUSH_RANDOM_PART)} as push_id
from tasks"""))
def q_push_id(spark, sf):
    t = _tasks(spark, sf)
    ms = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("created_at"))
    return t.select("id", E.push_id(ms).alias("push_id"))


@register("due_date_choice", with_texts("""
select id, strftime(cast(created_at as date), '%d/%m/%Y') as today,
       strftime(cast(created_at as date) + interval 1 day, '%d/%m/%Y') as tomorrow,
       strftime(cast(created_at as date) + interval 7 day, '%d/%m/%Y') as next_week from tasks"""))
def q_due_date_choice(spark, sf):
    return X.due_date_choices(_tasks(spark, sf))


def _feature(col):
    arr = F.array(*[F.lit(f) for f in R.FEATURES], F.lit(None).cast("string"))
    return F.element_at(arr, (col % 6).cast("int") + 1)


def d_feature(col):
    return "list_extract([" + ", ".join(q(f) for f in R.FEATURES) + f", null], cast({col} % 6 as int) + 1)"


@register("request_key", with_texts(f"""
select id, coalesce(nullif({d_feature('id')}, ''), {q(R.DEFAULT_FEATURE)}) || '_' || {d_trim('lower(task)')} as request_key
from tasks"""))
def q_request_key(spark, sf):
    t = _tasks(spark, sf)
    return t.select("id", E.request_key(_feature(F.col("id")), F.col("task")).alias("request_key"))


def _dispatch_sql() -> str:
    t = d_trim("task")
    feats = ", ".join(q(f) for f in R.FEATURES)
    first_step = " ".join(f"when {d_breakdown_key('tt.t')} = {q(k)} then {q(rows[0][0])}"
                          for k, rows in R.BREAKDOWN_TEMPLATES)
    first_sug = " ".join(f"when {d_topic('tt.t')} = {q(tp)} then {q(sug[0])}" for tp, sug in R.TOPIC_SUGGESTIONS)
    prio, _ = d_priority_pairs("lower(coalesce(tasks.task, ''))")
    routed = f"(case when {d_feature('tasks.id')} in ({feats}) then {d_feature('tasks.id')} else {q(R.DEFAULT_FEATURE)} end)"
    return with_texts(f"""
select tasks.id, {routed} as feature_used,
       case {routed}
         when 'task-breakdown' then (case {first_step} else {q(R.GENERIC_BREAKDOWN[0][0])} || tt.t end)
         when 'smart-prioritize' then {prio}
         when 'contextual-suggestions' then (case {first_sug} else {q(R.GENERIC_TOPIC_SUGGESTIONS[0])} end)
         when 'smart-scheduling' then {d_choice('tt.t', R.BEST_TIME_RULES, R.BEST_TIME_DEFAULT)}
         else p.task_name end as answer
from tasks join (select id, {t} as t from tasks) tt on tt.id = tasks.id
join parsed p on p.id = tasks.id""", parse_cte("tasks"))


@register("feature_dispatch", _dispatch_sql())
def q_feature_dispatch(spark, sf):
    t = _tasks(spark, sf)
    req = t.select("id", _feature(F.col("id")).alias("feature"), F.col("task").alias("text"))
    return X.feature_dispatch(req)


def _prompt_sql(feature: str, text: str, tasks_json: str) -> str:
    def fill(tmpl, val):
        head, tail = tmpl.split("{text}")
        un = lambda s: s.replace("{{", "{").replace("}}", "}")
        return f"({q(un(head))} || {val} || {q(un(tail))})"
    arms = " ".join(f"when {feature} = {q(f)} then "
                    f"{fill(R.PROMPTS[f], tasks_json if f == 'smart-prioritize' else text)}"
                    for f in R.FEATURES)
    return f"(case {arms} else {fill(R.PROMPTS[R.DEFAULT_FEATURE], text)} end)"


# Users u0-u9 send their context tasks to be prioritised, the others only the text.
@register("build_prompt", with_texts(f"""
select t.id, {_prompt_sql(d_feature('t.id'), 't.task', "coalesce(c.tasks_json, to_json([t.task])::varchar)")} as prompt
from tasks t left join (
  select user_id, to_json(list(task order by list_pos))::varchar as tasks_json
  from (select *, row_number() over (partition by user_id order by created_at desc, id desc) as list_pos from tasks) x
  where list_pos <= 20 and length(user_id) = 2 group by user_id) c on c.user_id = t.user_id"""))
def q_build_prompt(spark, sf):
    t = _tasks(spark, sf)
    listed = (L.context_tasks(t, n=20).where(F.length("user_id") == 2).groupBy("user_id")
              .agg(F.array_sort(F.collect_list(F.struct("list_pos", "task"))).alias("l"))
              .select("user_id", F.to_json("l.task").alias("tasks_json")))
    own = F.coalesce("tasks_json", F.to_json(F.array("task")))
    return t.join(listed, "user_id", "left").select(
        "id", E.build_prompt(_feature(F.col("id")), F.col("task"), own).alias("prompt"))
