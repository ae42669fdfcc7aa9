"""Sharding by global byte-size prefix sums.

Documents are put in id order over range partitions; each partition's total
gives it a start in the global byte line, and the line is cut at equal
targets. Every shard is a contiguous run of the order and differs from its
target by less than one document at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size: UTF-8 bytes of the text plus 1. A document belongs to the shard in
    which its middle byte lies; slot counts the rows of a shard from 0 in
    (id, size, crc) order. Equal rows take neighbouring places. Law ``bytes``;
    grown_shard is null, as one more shard moves every cut.

    Null text counts as empty (size 1, crc32 0), null ids sort first, an empty
    table gives an empty result, and other columns of ``docs`` are not read.

    The order is written to the checkpoint folder with its partition number,
    so totals and prefix sums see the same partitions even after a lost
    executor. The text is read once and never shuffled. Broadcast tables have
    one row per range partition, or one per shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"),
                       (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"))
    order = ["id", "size", "crc"]
    # Explicit count: the range partitions are the unit of the prefix sums.
    placed = cut(rows.repartitionByRange(partitions(docs), *order).withColumn("part", F.spark_partition_id()))

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    line = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))

    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = (placed.withColumn("end", F.sum("size").over(inside))
          .withColumn("nth", F.count("*").over(inside))
          .join(F.broadcast(line), "part")
          .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("end")) - F.col("size"))
          # decimal: middle * shards may pass 2^63 beyond an exabyte
          .withColumn("shard", F.floor(F.col("middle2").cast("decimal(25,0)") * n_shards
                                       / (2 * F.col("total")).cast("decimal(20,0)")).cast("int"))
          .withColumn("rank", F.col("rows_before") + F.col("nth") - 1))
    first = at.groupBy("shard").agg(F.min("rank").alias("first"))
    return (at.join(F.broadcast(first), "shard")
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
                    F.lit("bytes").alias("law"), "shard",
                    (F.col("rank") - F.col("first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
