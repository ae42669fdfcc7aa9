"""The fixture behind the text-rule queries reaches every arm of the rules."""

import pytest

import __spark_entry__ as entry
from tidemark.functions import rules as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def column(spark):
    queries = entry.queries()

    def get(key, name):
        return {r[0] for r in queries[key](spark, SF).select(name).distinct().collect()}
    return get


@pytest.mark.parametrize("key, name, want", [
    ("extract_priority", "extract_priority", {"high", "medium", "low"}),
    ("infer_category", "infer_category", {c for c, _ in R.CATEGORY_KEYWORDS} | {R.DEFAULT_CATEGORY}),
    ("estimate_duration", "estimate_duration", {d for d, _ in R.DURATION_KEYWORDS} | {R.DEFAULT_DURATION}),
    ("breakdown_total_time", "total_estimated_time", {None, R.TOTAL_TIME_LONG}),
    ("smart_prioritize", "ai_priority", {level for level, _ in R.PRIORITY_KEYWORDS}),
    ("task_breakdown", "task", {t for _, steps in R.BREAKDOWN_TEMPLATES for t, _, _ in steps}),
    ("contextual_suggestions", "category", {t for t, _ in R.TOPIC_SUGGESTIONS} | {R.DEFAULT_CATEGORY}),
    ("smart_schedule", "best_time", {t for _, t in R.BEST_TIME_RULES} | {R.BEST_TIME_DEFAULT}),
    ("smart_schedule", "preparation", {t for _, t in R.PREP_RULES} | {R.PREP_DEFAULT}),
    ("extract_date", "extract_date", {"March 5", "July 4", "tomorrow", "monday", "next month", "3/4", None}),
    ("extract_people", "extract_people", {"Anna Berg", "Tom", "Eve", "Clara Jones", ""}),
    ("parse_defaults", "priority", {"low", "medium"}),
    ("parse_defaults", "category", {"work", R.DEFAULT_CATEGORY}),
    ("parse_defaults", "estimated_duration", {"1 hour", R.DEFAULT_DURATION}),
    ("parse_defaults", "confidence", {0.1, 0.5, 0.9}),
])
def test_arms_are_reached(column, key, name, want):
    assert want <= column(key, name)


def test_every_suggestion_rule_is_reached(column):
    seen = " | ".join(x for x in column("task_suggestions", "suggestions") if x)
    wanted = [s for _, s in R.SUGGESTION_RULES] + [s for c, s in R.CATEGORY_FALLBACK_SUGGESTIONS if c != "home"]
    assert [s[0] for s in wanted if s[0] not in seen] == []  # no text has the category "home"


def test_children_pending_by_text_are_placed(spark):
    from pyspark.sql import functions as F
    from tidemark.sources.tables import load_views, pending_children
    t = pending_children(load_views(spark, SF)[0]).where(~F.col("archived") & F.col("metadata").contains("parentTask"))
    placed = entry.queries()["task_hierarchy"](spark, SF).where("is_child = 1").select("id").distinct()
    assert t.count() > 50 and t.join(placed, "id", "left_anti").count() == 0
