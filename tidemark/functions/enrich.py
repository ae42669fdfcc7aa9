"""Rule-based task text enrichment as Spark column expressions.

Every builder maps Columns to a Column with built-in functions only
(regexp_extract, rlike, CASE, arrays), so enrichment of billions of rows
stays in whole-stage codegen with no Python worker. The rule tables are in
``tidemark.functions.rules``; a CASE chain is generated from each table, so
first-match-wins order is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions.text import js_collapse_ws, js_trim, replace_first


def _contains_any(low: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = low.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_match(text: Column, patterns: list[str]) -> Column:
    """Whole match of the first pattern (by pattern order) that matches, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def extract_date(text: Column) -> Column:
    """H1: date token (today, weekday, d/m/y, month day)."""
    return first_match(text, R.DATE_PATTERNS)


def extract_time(text: Column) -> Column:
    """H2: clock time, else part of day."""
    return first_match(text, R.TIME_PATTERNS)


def extract_priority(text: Column) -> Column:
    """H3: high, low, else medium."""
    return (F.when(text.rlike(R.PRIORITY_HIGH_PATTERN), "high")
            .when(text.rlike(R.PRIORITY_LOW_PATTERN), "low").otherwise("medium"))


def extract_people(text: Column) -> Column:
    """H4: names from ``with Name`` and ``Name and me`` (case-sensitive), in pattern order."""
    names = F.array(*[F.regexp_extract(text, p, 1) for p in R.PEOPLE_PATTERNS])
    return F.filter(names, lambda x: x != "")


def infer_category(text: Column) -> Column:
    """H5: first category whose keyword occurs in the lower-cased text."""
    low = F.lower(text)
    out = F.lit(R.DEFAULT_CATEGORY)
    for cat, words in reversed(R.CATEGORY_KEYWORDS):
        out = F.when(_contains_any(low, words), F.lit(cat)).otherwise(out)
    return out


def smart_tags(text: Column) -> Column:
    """H6: independent tag tests, in table order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_contains_any(low, words), F.lit(tag)) for tag, words in R.SMART_TAGS]))


def estimate_duration(text: Column) -> Column:
    """H7: first duration whose keyword occurs, default 30 minutes."""
    low = F.lower(text)
    out = F.lit(R.DEFAULT_DURATION)
    for dur, words in reversed(R.DURATION_KEYWORDS):
        out = F.when(_contains_any(low, words), F.lit(dur)).otherwise(out)
    return out


def task_suggestions(name: Column, category: Column) -> Column:
    """H8: keyword groups on the task name, then the category fallback, then generic."""
    low = F.lower(name)
    out = _strings(R.GENERIC_SUGGESTIONS)
    for cat, sug in reversed(R.CATEGORY_FALLBACK_SUGGESTIONS):
        out = F.when(category == F.lit(cat), _strings(sug)).otherwise(out)
    for words, sug in reversed(R.SUGGESTION_RULES):
        out = F.when(_contains_any(low, words), _strings(sug)).otherwise(out)
    return out


def parse_confidence(text: Column, date: Column, time: Column, people: Column) -> Column:
    """H9: 0.5 + 0.2 (date) + 0.1 (time) + 0.1 (people) + 0.1 (length > 10), cap 1.

    Added in this order in double precision, so four hits give 0.9999999999999999.
    """
    conf = F.lit(R.CONFIDENCE_BASE)
    conf = F.when(date.isNotNull(), conf + F.lit(R.CONFIDENCE_DATE)).otherwise(conf)
    conf = F.when(time.isNotNull(), conf + F.lit(R.CONFIDENCE_TIME)).otherwise(conf)
    conf = F.when(F.size(people) > 0, conf + F.lit(R.CONFIDENCE_PEOPLE)).otherwise(conf)
    conf = F.when(F.length(text) > R.CONFIDENCE_LONG_OVER, conf + F.lit(R.CONFIDENCE_LONG)).otherwise(conf)
    return F.least(conf, F.lit(1.0))


def with_clean_name(df: DataFrame, text_col: str, out: str = "_clean_name") -> DataFrame:
    """Task name after removing the date, time and people matches (H11 name cleaning).

    Each removal takes out the first literal occurrence of the match found
    in the original text, then trims; finally white space is collapsed and
    one leading verb is dropped. May be empty. Every step is its own
    projection so the expression stays linear in the number of steps (the
    optimizer keeps non-trivial aliases instead of inlining them).
    """
    text = F.col(text_col)
    needles = [extract_date(text), extract_time(text)] + \
        [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in R.PEOPLE_PATTERNS]
    d = df.select("*", *[n.alias(f"_cn_m{i}") for i, n in enumerate(needles)])
    prev = text_col
    for i in range(len(needles)):
        m = F.col(f"_cn_m{i}")
        d = d.withColumn(f"_cn_s{i}", F.when(m.isNotNull(), js_trim(replace_first(F.col(prev), m)))
                         .otherwise(F.col(prev)))
        prev = f"_cn_s{i}"
    d = d.withColumn(out, F.regexp_replace(js_trim(js_collapse_ws(F.col(prev))), R.LEADING_VERB_PATTERN, ""))
    return d.drop(*[f"_cn_m{i}" for i in range(len(needles))], *[f"_cn_s{i}" for i in range(len(needles))])


PARSED_FIELDS = ["taskName", "date", "time", "priority", "people", "category", "tags",
                 "estimatedDuration", "suggestions", "confidence", "fastResponse"]


def quick_rule_index(text: Column) -> Column:
    """1-based index of the first quick prefix the lower-cased text starts with, else NULL."""
    low = F.lower(text)
    out = F.lit(None).cast("int")
    for i, (prefix, *_rest) in reversed(list(enumerate(R.QUICK_PREFIXES, 1))):
        out = F.when(low.startswith(prefix), F.lit(i)).otherwise(out)
    return out


def _quick_table() -> Column:
    return F.array(*[F.struct(F.lit(prefix).alias("prefix"), F.lit(cat).cast("string").alias("category"),
                              _strings(tags).alias("tags"), F.lit(prio or "medium").alias("priority"),
                              F.lit(dur or R.DEFAULT_DURATION).alias("duration"))
                     for prefix, cat, tags, prio, dur in R.QUICK_PREFIXES])


def with_smart_parse(df: DataFrame, text_col: str, out: str = "parsed") -> DataFrame:
    """Quick prefix result if any (H10), else the rule parser (H1-H9).

    The input is trimmed once. Intermediate results are columns of their
    own projections, so each regex runs once per row and the plan stays
    small: the quick rule is looked up by index in a literal array rather
    than repeated per prefix.
    """
    d = df.withColumn("_sp_t", js_trim(F.col(text_col)))
    t = F.col("_sp_t")
    d = d.select("*", extract_date(t).alias("_sp_dt"), extract_time(t).alias("_sp_tm"),
                 extract_people(t).alias("_sp_pp"), infer_category(t).alias("_sp_cat"),
                 quick_rule_index(t).alias("_sp_qi"))
    qi = F.col("_sp_qi")
    d = d.withColumn("_sp_q", F.when(qi.isNotNull(), F.element_at(_quick_table(), qi))).drop("_sp_qi")
    d = with_clean_name(d, "_sp_t", "_sp_name")
    quick = F.col("_sp_q").isNotNull()
    qf = F.col("_sp_q")
    rest = js_trim(F.call_function("substr", t, F.length(qf.getField("prefix")) + 1))
    d = d.withColumn("_sp_name", F.when(quick, rest).otherwise(F.col("_sp_name")))
    name = F.col("_sp_name")
    empty = F.array().cast("array<string>")
    rule_cat = F.col("_sp_cat")
    parsed = F.struct(
        F.when(name == "", t).otherwise(name).alias("taskName"),
        F.when(~quick, F.col("_sp_dt")).alias("date"),
        F.when(~quick, F.col("_sp_tm")).alias("time"),
        F.when(quick, qf.getField("priority")).otherwise(extract_priority(t)).alias("priority"),
        F.when(quick, empty).otherwise(F.col("_sp_pp")).alias("people"),
        F.when(quick, F.coalesce(qf.getField("category"), F.lit(R.DEFAULT_CATEGORY))).otherwise(rule_cat)
        .alias("category"),
        F.when(quick, qf.getField("tags")).otherwise(smart_tags(t)).alias("tags"),
        F.when(quick, qf.getField("duration")).otherwise(estimate_duration(t)).alias("estimatedDuration"),
        task_suggestions(name, F.when(quick, qf.getField("category")).otherwise(rule_cat)).alias("suggestions"),
        F.when(quick, F.lit(R.QUICK_CONFIDENCE))
        .otherwise(parse_confidence(t, F.col("_sp_dt"), F.col("_sp_tm"), F.col("_sp_pp"))).alias("confidence"),
        quick.alias("fastResponse"))
    return d.withColumn(out, parsed).drop("_sp_t", "_sp_dt", "_sp_tm", "_sp_pp", "_sp_cat", "_sp_q", "_sp_name")


def parse_defaults(parsed: Column, original: Column) -> Column:
    """Fill missing parsed fields the way the client does (``||`` defaults)."""
    def f(name):
        return parsed.getField(name)
    return F.struct(
        F.coalesce(F.nullif(f("taskName"), F.lit("")), original).alias("taskName"),
        f("date").alias("date"), f("time").alias("time"),
        F.coalesce(F.nullif(f("priority"), F.lit("")), F.lit("medium")).alias("priority"),
        F.coalesce(f("people"), F.array().cast("array<string>")).alias("people"),
        F.coalesce(F.nullif(f("category"), F.lit("")), F.lit(R.DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(f("tags"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.nullif(f("estimatedDuration"), F.lit("")), F.lit(R.DEFAULT_DURATION)).alias("estimatedDuration"),
        F.coalesce(f("suggestions"), F.array().cast("array<string>")).alias("suggestions"),
        F.coalesce(F.nullif(f("confidence"), F.lit(0.0)), F.lit(R.CONFIDENCE_BASE)).alias("confidence"))


STEP_TYPE = "array<struct<task:string,priority:string,estimatedTime:string>>"


def _steps(rows) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("task"), F.lit(p).alias("priority"), F.lit(e).alias("estimatedTime"))
                     for t, p, e in rows])


def breakdown_key(text: Column) -> Column:
    """Template key whose text contains the task or is contained in it, else NULL."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for key, _ in reversed(R.BREAKDOWN_TEMPLATES):
        hit = low.contains(key) | F.call_function("contains", F.lit(key), low)
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def breakdown_steps(text: Column) -> Column:
    """The template steps, else the three generic steps naming the task."""
    key = breakdown_key(text)
    generic = F.array(*[F.struct(F.concat(F.lit(pre), text).alias("task"), F.lit(p).alias("priority"),
                                 F.lit(e).alias("estimatedTime")) for pre, p, e in R.GENERIC_BREAKDOWN])
    out = generic
    for k, rows in reversed(R.BREAKDOWN_TEMPLATES):
        out = F.when(key == F.lit(k), _steps(rows)).otherwise(out)
    return out


def breakdown_total_time(text: Column) -> Column:
    """Templates only: more than 3 steps -> 1-2 days, else 2-4 hours; generic -> NULL."""
    key = breakdown_key(text)
    out = F.lit(None).cast("string")
    for k, rows in R.BREAKDOWN_TEMPLATES:
        total = R.TOTAL_TIME_LONG if len(rows) > R.TOTAL_TIME_STEPS_OVER else R.TOTAL_TIME_SHORT
        out = F.when(key == F.lit(k), F.lit(total)).otherwise(out)
    return out


def _priority_pairs():
    return [(level, w) for level, words in R.PRIORITY_KEYWORDS for w in words]


def ai_priority(text: Column) -> Column:
    """First level (urgent, high, medium, low) with a keyword in the text, else medium."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("medium")
    for level, word in reversed(_priority_pairs()):
        out = F.when(low.contains(word), F.lit(level)).otherwise(out)
    return out


def priority_reasoning(text: Column) -> Column:
    """The explanation naming the first matching keyword."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(R.PRIORITY_REASON_DEFAULT)
    for level, word in reversed(_priority_pairs()):
        out = F.when(low.contains(word), F.lit(R.PRIORITY_REASON_FORMAT % (level, word))).otherwise(out)
    return out


def suggestion_topic(text: Column) -> Column:
    """First topic contained in the lower-cased text, else NULL."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for topic, _ in reversed(R.TOPIC_SUGGESTIONS):
        out = F.when(low.contains(topic), F.lit(topic)).otherwise(out)
    return out


def by_topic(topic: Column, values: Callable[[list[str]], Column]) -> Column:
    """``values`` of the topic's suggestions, else of the generic four."""
    out = values(R.GENERIC_TOPIC_SUGGESTIONS)
    for t, sug in reversed(R.TOPIC_SUGGESTIONS):
        out = F.when(topic == F.lit(t), values(sug)).otherwise(out)
    return out


def contextual_suggestions(text: Column) -> Column:
    """The topic's suggestions, else the generic four."""
    return by_topic(suggestion_topic(text), _strings)


def _keyword_choice(text: Column, rules, default: str) -> Column:
    low = F.lower(text)
    out = F.lit(default)
    for words, value in reversed(rules):
        out = F.when(_contains_any(low, words), F.lit(value)).otherwise(out)
    return out


def best_time(text: Column) -> Column:
    """Recommended time of day."""
    return _keyword_choice(text, R.BEST_TIME_RULES, R.BEST_TIME_DEFAULT)


def preparation_time(text: Column) -> Column:
    """Preparation time."""
    return _keyword_choice(text, R.PREP_RULES, R.PREP_DEFAULT)


def buffer_time(text: Column) -> Column:
    """Buffer around the task."""
    return _keyword_choice(text, R.BUFFER_RULES, R.BUFFER_DEFAULT)


def schedule_conflicts(existing_count: Column) -> Column:
    """More than 5 existing tasks -> busy."""
    return F.when(F.coalesce(existing_count, F.lit(0)) > R.CONFLICT_OVER, F.lit(R.CONFLICT_BUSY)) \
        .otherwise(F.lit(R.CONFLICT_FREE))


def push_id(millis: Column) -> Column:
    """8 order-preserving base-64 characters of epoch millis + 12 x '-'."""
    chars = [F.substring(F.lit(R.PUSH_CHARS), (F.shiftright(millis, 6 * k).bitwiseAND(63) + 1).cast("int"), 1)
             for k in range(7, -1, -1)]
    return F.concat(*chars, F.lit(R.PUSH_RANDOM_PART))


def request_key(feature: Column, text: Column) -> Column:
    """``feature_`` + lower-cased, trimmed text; feature defaults to smart-parse."""
    f = F.coalesce(F.nullif(feature, F.lit("")), F.lit(R.DEFAULT_FEATURE))
    return F.concat(f, F.lit("_"), js_trim(F.lower(text)))


def build_prompt(feature: Column, text: Column, tasks_json: Column | None = None) -> Column:
    """The prompt text per feature (unknown -> smart-parse); prioritise embeds JSON."""
    def fill(tmpl: str, value: Column) -> Column:
        head, tail = tmpl.split("{text}")
        return F.concat(F.lit(head.replace("{{", "{").replace("}}", "}")), value,
                        F.lit(tail.replace("{{", "{").replace("}}", "}")))
    pjson = tasks_json if tasks_json is not None else F.to_json(F.array(text))
    out = fill(R.PROMPTS[R.DEFAULT_FEATURE], text)
    for feat in reversed(R.FEATURES):
        val = pjson if feat == "smart-prioritize" else text
        out = F.when(feature == F.lit(feat), fill(R.PROMPTS[feat], val)).otherwise(out)
    return out
