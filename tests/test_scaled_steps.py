"""Steps that went to one task, or grew past their input: matches by text, rows without a temporary id, stored buckets."""

import glob
from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions import enrich as E
from tidemark.operators import joins as J
from tidemark.operators import mutations as M
from tidemark.operators import search as S
from tidemark.operators import textrules as X
from tidemark.plans import q_writes as W
from tidemark.sources.tables import load_views
from tidemark.streaming import feeds as FD

SF = "/root/testdata/sf0.001"


def local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pending_children_of_one_text_are_joined_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SIDE", 3)
    roots = [(i, u, "Same" if i % 3 else None, None, None) for i in range(20) for u in ("u1", None)]
    roots += [(5, "u1", "Same", None, None), (900, "u2", "Other", None, None)]
    kids = [(100 + i, "u1" if i % 4 else None, "kid", None, '{"parentTask":"Same"}') for i in range(25)]
    kids += [(100, None, "kid", None, '{"parentTask":"Same"}'), (300, "u2", "kid", None, '{"parentTask":"Same"}'),
             (301, "u2", "kid", 900, '{"parentTask":"Other"}'), (302, "u2", "kid", None, '{"parentTask":"Other"}')]
    df = (spark.createDataFrame(roots + kids, "id long, user_id string, task string, parent_task_id long, metadata string")
          .withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")))
    got = J.task_hierarchy(df)
    want = Counter((u, i, i, 0) for i, u, *_ in roots)
    want += Counter((u, i, r, 1) for i, u, _, p, m in kids for r, ru, t, *_ in roots
                    if u == ru and (p == r if p is not None else t is not None and f'"{t}"' in m))
    assert Counter((r.user_id, r.id, r.root_id, r.is_child) for r in got.collect()) == want
    by_text = got.where("is_child = 1 and user_id = 'u1'")
    assert by_text.count() > 200 and tasks_with_rows(by_text) > 3
    assert J.task_hierarchy(df.limit(0)).count() == 0


def test_stored_rows_of_an_overlay_are_dealt_by_their_id(spark):
    t, _ = load_views(spark, SF)
    overlay = W._overlay(t)
    results = spark.createDataFrame([("temp-100000", 7), ("temp-100000", 8)], "temp_id string, stored_id long")
    keys = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "-1")
    try:
        got = M.confirm_overlay(overlay, results)
        assert tasks_with_rows(got) > 4
        want = Counter(r.id for r in overlay.where("temp_id is null").collect())
        want += Counter({7: 1, 8: 1}) if overlay.where("temp_id = 'temp-100000'").count() else Counter()
        assert Counter(r.id for r in got.collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_bucket_is_written_by_several_tasks(spark):
    t, _ = load_views(spark, SF)
    root, stored = FD.scratch_path(spark, "postings"), FD.scratch_path(spark, "by-lexeme")
    got = FD.search_vector_stream(spark, SF, t, root)
    for folder in (f"{local(root)}/v0/postings", f"{local(root)}/v1/postings"):
        assert max(len(glob.glob(f"{b}/*.parquet")) for b in glob.glob(f"{folder}/bucket=*")) > 1
    back = S.store_postings(got, stored).drop("bucket")
    rows = lambda df: sorted(map(str, df.select(*got.columns).collect()))
    assert rows(back) == rows(got)
    one = t.where("user_id = 'u1'").limit(1).select("user_id", F.lit("ship").alias("lexeme"))
    many = (one.crossJoin(spark.range(400)).select("user_id", "id", "lexeme", F.array(F.lit(1)).alias("positions")))
    S.store_postings(many, f"{stored}-one")
    assert len(glob.glob(f"{local(stored)}-one/bucket=*/*.parquet")) > 4


def test_suggestions_search_a_text_once(spark):
    texts = [(1, " Write a BLOG POST on the meeting "), (2, "project meeting"), (3, "project"), (4, "rest"), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "id long, task string")
    out = X.suggestions(df)
    got = {i: [r.text for r in out.where((F.col("id") == i) & (F.col("kind") == "suggestion")).orderBy("pos").collect()]
           for i, _ in texts}
    want = {r.id: r.s for r in df.select("id", E.contextual_suggestions(F.col("task")).alias("s")).collect()}
    assert got == want and len(got[1]) == 5 and got[5] == got[4]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "lambdafunction" not in plan
