"""Registered queries against DuckDB, and the pipeline against its stages' definitions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from tests.harness import compare, duck, duck_rows, spark_rows
from tests.llm.test_operators import brute_contamination, brute_print, clash, docs_frame, reach, words
from tidemark.llm import langid, quality
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, name):
    cols, rows, types = spark_rows(QUERIES[name](spark, SF))
    dcols, drows, dtypes = duck_rows(duck(SF), ORACLES[name])
    ok, msg = compare(cols, rows, dcols, drows)
    assert ok and types == dtypes, (msg, types, dtypes)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_row(spark, name):
    got = QUERIES[name](spark, SF)
    if name.startswith("op12"):
        assert got.filter("not agrees").count() == 0
    source = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op7') else 'documents'}.parquet")
    key = "page_id" if name.startswith("op7") else "doc_id"
    assert got.select(key).distinct().count() == source.count()


def test_entry_registers_all():
    import __spark_entry__ as e
    assert {f"op{n}_" for n in range(1, 14)} | {"pipeline"} <= {k.split("_")[0] + "_" if k[:2] == "op" and k[2].isdigit()
                                                               else k for k in e.queries()}


def test_stages(spark, tmp_path):
    """Every stage keeps exactly the rows that brute force keeps of its own input."""
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    extra = docs_frame(spark, [None, "", "123", item, item + " " + words(rng, 30)], ids=range(10**6, 10**6 + 5))
    docs = clash(docs).unionByName(extra)
    for name, stage in pipe.STAGES[:4]:
        stage(spark, docs, SF).write.parquet(out := str(tmp_path / name.replace(" ", "_")))
        before, after = docs.select(*pipe.COLUMNS).collect(), spark.read.parquet(out)
        assert after.columns == pipe.COLUMNS
        kept = {r["doc_id"] for r in after.collect()}
        assert set(map(tuple, after.collect())) <= set(map(tuple, before))
        if name == "SimHash near-dedup":
            p = [brute_print(r["text"]) for r in before]
            root = reach([{j for j, q in enumerate(p) if j != i and bin(x ^ q).count("1") <= 3} for i, x in enumerate(p)])
            groups = {}
            for r, g in zip(before, root):
                groups.setdefault(g, []).append(r["doc_id"])
            assert kept == {min(g) for g in groups.values()}
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = brute_contamination([r["text"] for r in before], items)
            assert kept == {r["doc_id"] for r, b in zip(before, bad) if not b[-1]} and 10**6 + 3 not in kept
        elif name == "quality classifier":
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), split=(5, 0))
            scores = quality.score(docs, model, 0.3).collect()
            assert kept == {r["doc_id"] for r in scores if r["score"] >= 0.3} and len(kept) >= 0.6 * len(before)
        else:
            found = langid.predict(docs, langid.train(docs, split=(4, 2))).collect()
            assert kept == {r["doc_id"] for r in found if r["lang_pred"] != "und" and not r["ambiguous"]}
            assert len(kept) >= 0.6 * len(before)
        docs = after
    ids = {r["doc_id"] for r in docs.collect()}
    packed = pipe.packing_stage(spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_stages_judge_rows_without_or_with_repeated_ids(spark):
    """Rows of one id and rows of none, contaminated, clean and copied: each row by its own text."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(9)
    a, b, c = (words(rng, 60, 10**6) for _ in range(3))
    rows = [(None, item), (5, item), (5, a), (None, b), (5, None), (None, c)]
    docs = docs_frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    kept = pipe.decontamination_stage(spark, docs, SF)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, rows[2:]))
    rows = [(None, a), (None, a), (7, b), (7, b), (9, c), (8, c), (None, c), (None, None), (3, ""), (None, item)]
    docs = docs_frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    kept = [(r["doc_id"], r["text"]) for r in pipe.simhash_stage(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, a), (7, b), (8, c), (3, ""), (None, item)]))


def test_stages_on_no_documents(spark):
    docs = docs_frame(spark, ["a"]).limit(0)
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, SF).count() == 0
