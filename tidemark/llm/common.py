"""Helpers shared by the operators: lineage cuts, whole-key runs, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy.

    Rows computed twice (sampling, ids by partition, Python steps) are then
    the same rows, and a lost executor re-reads the copy.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` over the session's shuffle partitions."""
    return df.repartition(partitions(df), *keys)


def in_split(id_col: str, mod: int, remainder: int) -> Column:
    """True for rows whose crc32 of the id as text has this remainder (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == remainder


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup key-sorted batches so that no key spans two chunks.

    Yields (table, starts): ``starts`` holds the first row of each key plus the
    row count. At most one batch and one key's rows are held at a time, so
    callers bound the rows of a key first.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        starts = _starts(table, keys)
        last = int(starts[-2])
        if last:
            yield table.slice(0, last).combine_chunks(), starts[:-1]
        rest = table.slice(last).combine_chunks().to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def per_key(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch],
            schema: str) -> DataFrame:
    """Apply ``fn`` to chunks of whole keys (rows of one key are adjacent)."""
    def run(batches):
        for table, starts in key_runs(batches, keys):
            yield fn(table, starts)
    return by_parts(df, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each of ``n`` rows by the links (a, b)."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component = smallest node reachable.

    Alternating large-star and small-star contraction (Kiveris et al., 2014):
    each step is one aggregation and one join on the node, and the number of
    steps grows with the logarithm of the graph. A hub's neighbours are
    combined before the shuffle and its join partition can be split, because
    the hub's side holds one row. Raises if ``max_rounds`` are not enough; no
    partial result is returned.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = cut(e)
    seen = _digest(e)
    if seen[0] == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written out: both sides of the join are then plain shuffles, and a hub's rows can be split
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = (both.join(low, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                .unionByName(small.select("a", F.col("m").alias("b")))
                .distinct())
        now = _digest(e)
        if now == seen:
            roots = e.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
            return e.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")).first()
    return (r[0], r[1])
