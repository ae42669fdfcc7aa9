"""Corpus pipeline: quality, language, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs. All but the last return the rows
they keep with the columns of ``documents``. Decisions are of rows, not of ids: the
near-duplicate and benchmark stages number their input rows and work on the
numbers, so rows without an id or with a repeated one are judged by their own texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, packing, quality, simhash
from tidemark.llm.queries import table, tokenizer_path
from tidemark.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, written before it is used so that it stays the row's own."""
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), split=(5, 0))
    return _keep(docs, lambda text: quality.score_text(model, text) >= 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: ``und`` and ambiguous decisions go."""
    model = langid.train(docs, split=(4, 2))

    def known(text):
        lang, _, _, ambiguous = langid.decode(model, text)
        return lang != "und" and not ambiguous
    return _keep(docs, known)


def _keep(docs: DataFrame, good) -> DataFrame:
    """Rows whose text is ``good``; a filter on the row itself needs no join back."""
    import pyarrow as pa
    docs = docs.select(*COLUMNS)

    def run(batches):
        for batch in batches:
            text = batch.column(COLUMNS.index("text"))
            yield batch.filter(pa.array([good(t.as_py()) for t in text], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, any one if none has an id."""
    rows = _numbered(spark, docs)
    got = simhash.near_duplicates(_by_row(rows), shingle=3, max_bits=3)
    ids = rows.select("row", "doc_id")
    first = (got.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row").groupBy("component_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    rows = _numbered(spark, docs)
    got = decontam.contamination(_by_row(rows), table(spark, sf_dir, "benchmark"))
    bad = got.filter("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(bad, "row", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces in sequences of 4096 ids."""
    return packing.pack_documents(docs, tokenizer_path(), 4096)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

# Fingerprints, classifiers and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; results go through the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
