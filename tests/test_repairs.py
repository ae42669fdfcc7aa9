"""Cases that no fixture row reaches: long chains, far terms, repeated edits, failed writes, ids of a batch."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lists as L
from tidemark.operators import mutations as M
from tidemark.operators import search as S
from tidemark.operators.hierarchy import descendants, state_cascade

NOW = "2024-03-01 00:00:00"


def chain(spark, n):
    return spark.createDataFrame([(i, i - 1 if i else None, False) for i in range(n)],
                                 "id long, parent_task_id long, archived boolean")


def test_cascades_reach_the_end_of_a_long_chain(spark):
    t = chain(spark, 24)
    got = {r.id: r.level for r in descendants(t, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {i: i for i in range(24)}
    ch = spark.createDataFrame([(0, True), (0, False), (12, False)], "id long, new_state boolean")
    state = {r.id: r.new_state for r in state_cascade(t, ch).collect()}
    # both states named for one id: set; an explicit row stops the cascade
    assert state == {**{i: True for i in range(12)}, 12: False}


def walk_down(edges, seeds):
    """Brute force: level of every id under the seeds, breadth first."""
    got, front, level = {s: 0 for s in seeds}, set(seeds), 0
    while front:
        level += 1
        front = {i for i, p in edges if p in front and i not in got}
        got |= dict.fromkeys(front, level)
    return got


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    from pyspark.sql import DataFrame
    n = 10_000
    t = chain(spark, n)
    calls, plain = [], type(t).checkpoint
    monkeypatch.setattr(type(t), "checkpoint", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    got = descendants(t, spark.createDataFrame([(0,)], "id long"))
    assert len(calls) < 20 and isinstance(got, DataFrame)
    assert got.count() == n and got.where("id <> level").count() == 0
    calls.clear()
    state = state_cascade(t, spark.createDataFrame([(0, True), (7000, False)], "id long, new_state boolean"))
    assert len(calls) < 22
    assert state.where("new_state").count() == 7000 and state.count() == 7001


def test_closure_of_trees_cycles_and_repeated_rows(spark):
    import random
    for seed in range(6):
        rng = random.Random(seed)
        n = 60
        edges = [(i, rng.choice([None, rng.randrange(n), rng.randrange(max(i, 1)), 999, i])) for i in range(n)]
        edges += [(1, 2), (2, 3), (3, 1)] if seed % 2 else []          # a cycle, and ids of several parents
        edges += rng.sample(edges, 10) + [(None, 1), (None, None)]     # repeated rows and null ids
        seeds = rng.sample(range(n), 3) + [999 if seed > 2 else 3]     # 999 has children but no row
        t = spark.createDataFrame(edges, "id long, parent_task_id long")
        named = spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]] + [(None,)], "id long")
        got = descendants(t, named).collect()
        want = walk_down([e for e in edges if e[0] is not None and e[1] is not None], seeds)
        assert {r.id: r.level for r in got} == want and len(got) == len(want)
    assert descendants(t, named.limit(0)).count() == 0 and descendants(t.limit(0), named).count() == 4


def test_state_cascade_equals_a_walk(spark):
    import random
    for seed in range(5):
        rng = random.Random(seed)
        n = 80
        up = {i: rng.choice([None, rng.randrange(max(i, 1)), rng.randrange(n)]) for i in range(n)}
        state = {i: rng.choice([True, False, False, None]) if seed else False for i in range(n)}
        ch = {i: rng.random() < .7 for i in rng.sample(range(n), 9)} | {10**6: True}
        want, front = {i: s for i, s in ch.items() if i in up}, [i for i, s in ch.items() if i in up and state[i] == (not s)]
        while front:
            front = [want.__setitem__(c, want[p]) or c for p in front for c in range(n)
                     if up[c] == p and c not in want and state[c] == (not want[p])]
        t = spark.createDataFrame([(i, up[i], state[i]) for i in up], "id long, parent_task_id long, archived boolean")
        got = state_cascade(t, spark.createDataFrame(list(ch.items()), "id long, new_state boolean"))
        assert {r.id: r.new_state for r in got.collect()} == want


def test_rank_counts_far_pairs(spark):
    far = " ".join(["alpha", *["x"] * 150, "beta"])
    two = " ".join(["alpha", *["x"] * 150, "beta", *["y"] * 150, "alpha"])
    t = spark.createDataFrame([(1, "u", far, None), (2, "u", two, None), (3, "u", "alpha beta", None)],
                              "id long, user_id string, task string, metadata string")
    q = spark.createDataFrame([("u", "alpha beta")], "user_id string, query string")
    got = {r.id: r.relevance_score for r in S.search_rank(t, q).collect()}
    assert math.isclose(got[1], 1e-16, rel_tol=1e-6) and math.isclose(got[2], 2e-16, rel_tol=1e-6)
    assert got[3] > 0.09


def overlay_base(spark):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, f"t{i}", "low", False, "u1", at, at) for i in range(1, 6)],
                                 "id long, task string, priority string, archived boolean, user_id string, "
                                 "created_at timestamp_ntz, updated_at timestamp_ntz")


def test_overlay_keeps_the_last_edit_and_reverts_failures(spark):
    base = overlay_base(spark)
    ops = spark.createDataFrame(
        [(1, "update", 1, None, "zzz first edit", None, "u1"), (2, "update", 1, None, None, "high", "u1"),
         (3, "update", 1, None, "aaa second edit", None, "u1"), (4, "archive", 2, None, None, None, "u1"),
         (5, "delete", 3, None, None, None, "u1"), (6, "add", None, "temp-1", "new", "low", "u1"),
         (7, "add", None, "temp-2", "lost", "low", "u1"), (8, "delete", 4, None, None, None, "u1"),
         (9, "update", 4, None, "gone", None, "u1")],
        "seq int, op string, id long, temp_id string, task string, priority string, user_id string")
    ov = M.pending_overlay(base, ops, as_of=NOW)
    got = {r.id or r.temp_id: r for r in ov.collect()}
    assert sorted(map(str, got)) == ["1", "2", "5", "temp-1", "temp-2"]
    assert (got[1].task, got[1].priority, got[1]._optimistic) == ("aaa second edit", "high", True)
    assert got[2].list == "archived" and not got[5]._optimistic
    done = M.confirm_overlay(ov, spark.createDataFrame([("temp-1", 50), ("temp-2", None)], "temp_id string, stored_id long"),
                             base, spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    got = {r.id: r for r in done.collect()}
    assert sorted(got) == [1, 2, 3, 5, 50] and not any(r._optimistic for r in got.values())
    old = {r.id: r for r in base.collect()}
    for i in (1, 2, 3):
        assert all(got[i][c] == old[i][c] for c in base.columns) and got[i].list == "active"
    assert got[50].task == "new"


def test_batch_ids_do_not_depend_on_partitions(spark):
    base = overlay_base(spark)
    rows = spark.createDataFrame([(f"task {i % 7}", "1", "u1") for i in range(40)],
                                 "task string, project_id string, user_id string")
    got = [sorted((r.id, r.task) for r in M.insert_rows(base, rows.repartition(n), as_of=NOW).where("id > 5").collect())
           for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and [i for i, _ in got[0]] == list(range(6, 46))


def test_expect_single(spark):
    one = spark.range(5).where("id = 3")
    assert L.expect_single(one).collect()[0].id == 3
    for df in (spark.range(0), spark.range(2)):
        with pytest.raises(Exception, match="exactly one row"):
            L.expect_single(df).collect()


def test_subscription_of_one_user(spark):
    feed = spark.createDataFrame([(1, "UPDATE", 1, "u2"), (2, "DELETE", 2, "u9"), (3, "UPDATE", 3, "u3")],
                                 "event_id long, operation string, task_id long, user_id string")
    tasks = spark.createDataFrame([(1, "u1"), (2, "u1"), (3, "u3")], "id long, user_id string")
    got = {r.event_id for r in M.user_change_stream(feed, tasks, user="u1").collect()}
    assert got == {1, 2} and M.user_change_stream(feed, tasks).where(F.col("event_id") == 3).count() == 1
