"""Edge frames for reports, cascades, quality checks and the cache fold (FIXTURES §3)."""

import datetime as dt


from tidemark.operators import analytics as A
from tidemark.operators import mutations as M
from tidemark.operators import quality as Q
from tidemark.sources.tables import TASK_SCHEMA
from tidemark.streaming.feeds import ttl_dedup

T0 = dt.datetime(2024, 5, 1)


def tasks(spark, rows):
    full = []
    for r in rows:
        d = dict(id=None, task="t", project_id="1", date=None, priority="medium", archived=False, user_id="u1",
                 ai_enhanced=False, metadata=None, parent_task_id=None, created_at=T0, updated_at=T0)
        d.update(r)
        full.append(tuple(d[f.name] for f in TASK_SCHEMA.fields))
    return spark.createDataFrame(full, TASK_SCHEMA)


def test_rates_and_null_priority(spark):
    t = tasks(spark, [dict(id=1, archived=True, updated_at=T0 + dt.timedelta(days=1, seconds=30)),
                      dict(id=2, priority=None), dict(id=3)])
    r = A.user_analytics_scalars(t).first()
    assert r.total_tasks == 3 and r.completed_tasks == 1
    assert str(r.completion_rate) == "33.33"
    # fractional seconds kept: 1 day + 30 s
    assert abs(r.average_completion_time_days - (1 + 30 / 86400)) < 1e-12
    prio = {x.priority: x.task_count for x in A.tasks_by_priority(t).collect()}
    assert prio == {"medium": 2}


def test_user_without_tasks_gets_zero_row(spark):
    t = tasks(spark, [dict(id=1)])
    p = spark.createDataFrame([("1", "Inbox", "u1", T0, T0)], "id string, name string, user_id string, "
                                                               "created_at timestamp_ntz, updated_at timestamp_ntz")
    r = A.user_analytics(t, p, as_of="2024-05-15 00:00:00", user_id="nobody").first()
    assert r.total_tasks == 0 and str(r.completion_rate) == "0.00"


def test_velocity_threshold_seven_and_eight(spark):
    as_of = "2024-05-15 00:00:00"
    recent = dt.datetime(2024, 5, 14)
    seven = tasks(spark, [dict(id=i, archived=True, updated_at=recent) for i in range(7)])
    eight = tasks(spark, [dict(id=i, archived=True, updated_at=recent) for i in range(8)])
    assert str(A.completion_velocity(seven, as_of=as_of).first()[1]) == "0.00"
    assert str(A.completion_velocity(eight, as_of=as_of).first()[1]) == "1.14"


def test_peak_day_ties_take_lowest(spark):
    # one Sunday (0) and one Monday (1) completion: tie -> 0
    t = tasks(spark, [dict(id=1, archived=True, updated_at=dt.datetime(2024, 5, 12, 9)),
                      dict(id=2, archived=True, updated_at=dt.datetime(2024, 5, 13, 8))])
    r = A.insight_scalars(t, as_of="2024-05-15 00:00:00").first()
    assert r.peak_productivity_day == 0 and r.peak_productivity_hour == 8


def test_archive_cascade_stops_at_already_archived(spark):
    # 1 -> 2 (already archived) -> 3 ; 1 -> 4
    t = tasks(spark, [dict(id=1), dict(id=2, parent_task_id=1, archived=True), dict(id=3, parent_task_id=2),
                      dict(id=4, parent_task_id=1)])
    ch = spark.createDataFrame([(1, True)], "id long, new_state boolean")
    out = {r.id: r.archived for r in M.archive_cascade(t, ch, as_of="2024-05-15 00:00:00").collect()}
    assert out == {1: True, 2: True, 3: False, 4: True}


def test_delete_cascade_survives_cycle(spark):
    t = tasks(spark, [dict(id=1, parent_task_id=2), dict(id=2, parent_task_id=1), dict(id=3, parent_task_id=1),
                      dict(id=5)])
    left = [r.id for r in M.delete_cascade(t, spark.createDataFrame([(1,)], "id long")).collect()]
    assert left == [5]


def test_constraint_violations_null_passes(spark):
    t = tasks(spark, [dict(id=1, priority=None), dict(id=2, priority="urgent"), dict(id=3, task="   "),
                      dict(id=4, task="\t"), dict(id=5, parent_task_id=5)])
    got = sorted((r.rule, r.id) for r in Q.constraint_violations(t).collect())
    # SQL TRIM removes spaces only: a tab-only task passes
    assert got == [("check_no_self_parent", 5), ("check_priority", 2), ("check_task_not_empty", 3)]


def test_patch_absent_differs_from_null(spark):
    t = tasks(spark, [dict(id=1, date="01/01/2024", priority="low"), dict(id=2, date="02/01/2024")])
    p = spark.createDataFrame([(1, None, True, "high", False)],
                              "id long, date string, set_date boolean, priority string, set_priority boolean")
    out = {r.id: r for r in M.patch_rows(t, p, as_of="2024-05-15 00:00:00").collect()}
    assert out[1].date is None and out[1].priority == "low"
    assert out[1].updated_at == dt.datetime(2024, 5, 15) and out[2].updated_at == T0


def test_ttl_fold_hits_do_not_extend(spark):
    base = dt.datetime(2024, 1, 1)
    ts = [0, 100, 299, 300, 301, 900, 1201]
    ev = spark.createDataFrame([(i, base + dt.timedelta(seconds=s), "k") for i, s in enumerate(ts)],
                               "event_id long, ts timestamp_ntz, event_type string")
    got = [r.is_miss for r in ttl_dedup(ev, "event_type").orderBy("event_id").collect()]
    assert got == [True, False, False, True, False, True, True]


def test_search_stemming_and_stop_words(spark):
    from tidemark.operators import search as S
    t = tasks(spark, [dict(id=1, task="Buy batteries and bolts"), dict(id=2, task="the bolt")])
    q = spark.createDataFrame([("u1", "bolts battery")], "user_id string, query string")
    got = {r.id: r.relevance_score for r in S.search_rank(t, q).collect()}
    assert list(got) == [1] and got[1] > 0
    q2 = spark.createDataFrame([("u1", "the and")], "user_id string, query string")
    assert S.search_match(t, q2).count() == 0


def test_user_analytics_record_matches_long_forms(spark):
    """The one-scan grouping-sets record equals the oracle-checked long forms."""
    from tidemark.sources.tables import load_views
    t, p = load_views(spark, "/root/testdata/sf0.001")
    as_of = "2024-05-15 00:00:00"
    rec = {r.user_id: r for r in A.user_analytics(t, p, as_of=as_of).collect()}
    sc = {r.user_id: r for r in A.user_analytics_scalars(t).collect()}
    assert set(rec) == set(sc)
    pr, pj, tr = {}, {}, {}
    for r in A.tasks_by_priority(t).collect():
        pr.setdefault(r.user_id, {})[r.priority] = r.task_count
    for r in A.tasks_by_project(t, p).collect():
        pj.setdefault(r.user_id, {})[r.project_name] = r.task_count
    for r in A.productivity_trend(t, as_of=as_of).collect():
        tr.setdefault(r.user_id, []).append((r.date, r.completed, r.created))
    for u, r in rec.items():
        s = sc[u]
        assert (r.total_tasks, r.completed_tasks, r.completion_rate, r.ai_enhanced_percentage) == \
            (s.total_tasks, s.completed_tasks, s.completion_rate, s.ai_enhanced_percentage)
        assert r.average_completion_time_days == s.average_completion_time_days
        assert dict(r.tasks_by_priority) == pr.get(u, {})
        assert dict(r.tasks_by_project) == pj.get(u, {})
        assert [tuple(x) for x in r.productivity_trend] == sorted(tr.get(u, []))


def test_productivity_insights_record_matches_long_forms(spark):
    from tidemark.sources.tables import load_views
    t, p = load_views(spark, "/root/testdata/sf0.01")
    as_of = "2024-05-15 00:00:00"
    rec = {r.user_id: r for r in A.productivity_insights(t, p, as_of=as_of).collect()}
    sc = {r.user_id: r for r in A.insight_scalars(t, as_of=as_of).collect()}
    assert set(rec) == set(sc)
    daily, perf = {}, {}
    for r in A.daily_completions(t, as_of=as_of).collect():
        daily.setdefault(r.user_id, []).append((r.date, r.completed, r.avg_completion_time_hours,
                                                r.ai_enhanced_completed))
    for r in A.project_performance(t, p, as_of=as_of).collect():
        perf.setdefault(r.user_id, set()).add((r.project_name, r.completion_rate, r.avg_completion_time))
    for u, r in rec.items():
        s = sc[u]
        assert (r.peak_productivity_day, r.peak_productivity_hour, r.completion_velocity, r.ai_task_success_rate) == \
            (s.peak_productivity_day, s.peak_productivity_hour, s.completion_velocity, s.ai_task_success_rate)
        assert [tuple(x) for x in (r.daily_completions or [])] == sorted(daily.get(u, []))
        assert {tuple(x) for x in (r.project_performance or [])} == perf.get(u, set())
