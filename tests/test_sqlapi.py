"""Search and reports called from SQL: the rows of the operators, for one user and for many."""

import datetime as dt
import random

import pytest

from tidemark.functions import sqlapi
from tidemark.operators import analytics as A
from tidemark.operators import search as S
from tidemark.plans.registry import REPORT_AS_OF
from tidemark.sources.tables import load_views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own(spark):
    """Texts with repeated, distant, missing and stop words; nulls in every column but the id."""
    rng = random.Random(3)
    words = ["ring", "rings", "boxes", "the", "flies", "plan's", "Größe", "x", "bus"]
    at = dt.datetime(2024, 1, 1)
    tasks = [(i, rng.choice(["a", "b", None]), rng.choice([None, " ".join(rng.choices(words, k=rng.choice([0, 3, 9]))),
                                                           "ring " + "x " * rng.choice([98, 99, 100, 150]) + "box"]),
              rng.choice(["p", "q", None]), rng.choice([None, "high"]), rng.choice([False, False, True, None]),
              rng.choice([None, '{"category":"ring","tags":["bus"]}', "{"]), at + dt.timedelta(days=rng.randrange(9)))
             for i in range(160)]
    t = spark.createDataFrame(tasks, "id long, user_id string, task string, project_id string, priority string, "
                                     "archived boolean, metadata string, created_at timestamp_ntz")
    return t, spark.createDataFrame([("p", "Prime")], "id string, name string")


def test_search_for_one_user_and_for_many(spark, own):
    t, p = own
    sqlapi.register_search(spark, t, p, k=20)
    texts = ["ring", "Rings box", "the", "", "bus flies the ring", "größe", "nothing", None, "ring'; x"]
    queries = spark.createDataFrame([(u, q) for q in texts for u in ("a", "b", None, "nobody")], "user_id string, query string")
    many = spark.sql("SELECT u.query, u.user_id, s.* FROM {q} u, LATERAL search_tasks(u.user_id, u.query) s", q=queries)
    assert "NestedLoop" not in many._jdf.queryExecution().toString() and "Cartesian" not in many._jdf.queryExecution().toString()
    got = many.collect()
    cols = ["id", "task", "project_name", "priority", "created_at", "relevance_score"]
    found = 0
    for q in texts[:5]:
        one = queries.where(queries["query"] == q)
        want = S.search_tasks(t, p, one, k=20)
        mine = [r for r in got if r["query"] == q]
        assert sorted(str(tuple(r[c] for c in ["user_id", *cols])) for r in mine) == sorted(
            str(tuple(r)) for r in want.select("user_id", *cols).collect()), q
        found += len(mine)
    assert found > 40 and not [r for r in got if r["query"] in ("the", "", "nothing", None) or r.user_id in (None, "nobody")]
    assert {r["query"] for r in got} >= {"ring", "Rings box", "größe"}
    one = spark.sql("SELECT * FROM search_tasks('a', 'ring')").collect()
    assert [tuple(r) for r in one] == [tuple(r)[2:] for r in S.search_tasks(
        t, p, spark.createDataFrame([("a", "ring")], "user_id string, query string"), k=20).orderBy("result_pos").collect()]


def test_reports_are_the_operators_json(spark):
    t, p = load_views(spark, SF)
    sqlapi.register_search(spark, t, p)
    sqlapi.register_reports(spark, t, p, as_of=REPORT_AS_OF, days_back=60)
    t.select("user_id").distinct().createOrReplaceTempView("every_user")
    got = spark.sql("SELECT user_id, get_user_analytics(user_id) AS a, get_productivity_insights(user_id) AS i FROM every_user")
    want = {r.user_id: r.analytics for r in A.user_analytics_json(t, p, as_of=REPORT_AS_OF).collect()}
    assert {r.user_id: r.a for r in got.collect()} == want and all(r.i.startswith("{") for r in got.collect())
    none = spark.sql("SELECT get_user_analytics('nobody') AS a, get_productivity_insights(null) AS i").first()
    assert none.a is None and none.i is None
    plan = spark.sql("SELECT * FROM search_tasks('u3', 'ring')")._jdf.queryExecution().toString()
    assert "= u3" in plan  # the user's id reaches the scan
