"""Filter interaction audit by contingency tensors.

Every document fails or passes each of five filters, so a part of the table
is a 2 x 2 x 2 x 2 x 2 tensor of counts. Spark fills the tensors; each step of
each filter order is then a contraction that takes pass, fail or both along
every axis.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
       "good_lost long, toxic_lost long, shapley long")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, fails): the filters A to D that each text fails, as bits 0 to 3.

    A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * A-Z
    characters > 10 * code points. D: one of #$%&*|.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split("_text", "[ \\t-\\r]+"), "")
    facts = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit(""))
                         .alias("part"), text.alias("_text"))
             .withColumn("_words", words)
             .select("id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), F.size("_words").alias("n"),
                     F.size(F.array_distinct("_words")).alias("d"), F.char_length("_text").alias("chars"),
                     F.regexp_count("_text", F.lit("[A-Z]")).alias("capitals"),
                     F.col("_text").rlike("[#$%&*|]").alias("marked")))
    bits = [F.col("n") < 100, F.col("d").cast("long") * 100 < F.col("n").cast("long") * 80,
            F.col("capitals").cast("long") * 100 > F.col("chars").cast("long") * 10, F.col("marked")]
    code = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return facts.select("id", "part", "digest", code.cast("int").alias("fails"))


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents of each part by the filters they fail (E is bit 4).

    E asks for the smallest id of a text over the whole table, but needs no
    join back: copies are added up by (text, part, label), where all but the
    rows of the smallest id of the text fail E, so a text with a third of all
    rows leaves each map task as a few rows. A label row that says 1 counts; rows
    without an id get no label and neither fail E nor make others fail it.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    per_id = failures(docs).groupBy("id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    no = F.lit(False)
    rows = (per_id.join(marks, "id", "left")
            .withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}))
    copies = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    # one row per part and label combination of a text
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    copies = copies.withColumn("passing", F.col("no_id") + F.when(
        F.col("first.id") == smallest, F.col("first.n")).otherwise(0))
    cells = copies.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("fails"), F.col("passing").alias("n")),
        F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("passing")).alias("n")))).alias("c"))
    return cells.groupBy("part", F.col("c.fails").alias("fails")).agg(
        F.sum("c.n").alias("n"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"))


def contract(counts: np.ndarray) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique, good lost, toxic lost, shapley) from counts (3, 2, 2, 2, 2, 2).

    Axis 0 is all, good and toxic documents; axis 1 + i is 0 where filter i
    is passed and 1 where it is failed.
    """
    one, zero, every = np.array([0, 1]), np.array([1, 0]), np.array([1, 1])
    orders = list(permutations(range(len(FILTERS))))
    takes = np.empty((4, len(orders), len(FILTERS), len(FILTERS), 2), np.int64)
    for o, order in enumerate(orders):
        for step, own in enumerate(order):
            for axis in range(len(FILTERS)):
                before = axis in order[:step]
                takes[0, o, step, axis] = zero if before or axis == own else every  # kept
                takes[1, o, step, axis] = one if axis == own else zero if before else every  # removed
                takes[2, o, step, axis] = one if axis == own else every  # failing, wherever removed
                takes[3, o, step, axis] = one if axis == own else zero  # failing nothing else
    got = np.einsum("gabcde,ksta,kstb,kstc,kstd,kste->kstg", counts, *(takes[:, :, :, i] for i in range(5)), optimize=True)
    removed = got[1, :, :, 0]
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, np.array(orders), removed)
    return [("".join(FILTERS[f] for f in order), step + 1, got[0, o, step, 0], removed[o, step],
             got[2, o, step, 0] - removed[o, step], got[3, o, step, 0], got[1, o, step, 1], got[1, o, step, 2],
             shapley[own])
            for o, order in enumerate(orders) for step, own in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step, zeros included, of all 120 orders of the five filters.

    A part is a language, the empty string for null (and for an empty one).
    Null texts are empty: no words, and copies of each other. Repeated rows of
    one id count each time; equal texts of one id do not fail E. An empty
    table has no parts and gives no rows; labels of unknown ids and other
    columns are not read. A part's tensor has 32 cells, which is all that one
    group holds.
    """
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, 32), np.int64)
        counts[:, cells["fails"]] = cells[["n", "good", "toxic"]].to_numpy(np.int64).T
        # bit i of the code is axis i: the lowest bit varies fastest, so axes come out reversed
        tensor = counts.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
        rows = contract(tensor)
        return pd.DataFrame([(cells["part"].iloc[0], *map(lambda v: v if isinstance(v, str) else int(v), r)) for r in rows],
                            columns=[c.split()[0] for c in OUT.split(", ")])
    return contingency(docs, labels).groupBy("part").applyInPandas(run, OUT)
