"""SimHash near-duplicates by pigeonhole blocks.

Every whole text gets a 64-bit fingerprint of its word shingles. Fingerprints
are split into ``max_bits + 2`` blocks: two that differ in at most
``max_bits`` bits agree on two whole blocks, so each distinct fingerprint is
listed under every pair of its blocks, and only those that share a listing are
compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, forest, per_key

TILE = 512  # fingerprints of one listing compared at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: A-Z lower-cased, words split at ASCII white space, XXH64 (seed 42) of each shingle."""
    import xxhash
    # bytes.lower() and bytes.split() know ASCII only, as the definition asks
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65536):
        h = np.fromiter(map(digest, [line[s:e] for s, e in zip(starts[at:at + 65536], ends[at:at + 65536])], repeat(42)),
                        np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed long; one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long")


def _blocks(n: int) -> list[int]:
    """64-bit masks of ``n`` blocks of nearly equal width."""
    cuts = [0, *accumulate([64 // n + (i < 64 % n) for i in range(n)])]
    return [((1 << e) - 1) ^ ((1 << s) - 1) for s, e in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(table: pa.Table, starts: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """A spanning forest of the close fingerprints of each key, as (a, b) of their representatives."""
    fp, rep = table.column("fp").to_numpy(), table.column("rep").to_numpy()
    left_key = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at, found_a, found_b = np.arange(len(fp)), [], []
    step = 1
    while True:  # compare each row with the step-th after it, as long as a key has so many rows
        at = at[at + step < len(fp)]
        at = at[left_key[at] == left_key[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
        found_a.append(near)
        found_b.append(near + step)
        step += 1
    none = np.zeros(0, np.int64)
    lab = forest(len(fp), np.concatenate([none, *found_a]), np.concatenate([none, *found_b]))
    own = np.flatnonzero(lab != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[lab[own]])], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most
    ``max_bits`` differing bits. Null, empty and white-space texts have the
    fingerprint zero, linked like any other; equal fingerprints are one node,
    so copies are never paired; rows with equal ids keep a row each; an empty
    table gives an empty result; a null id never names a component that has
    another id. Other columns are not read.

    A listing that holds many different fingerprints is cut into tiles by hash,
    and each pair of tiles is compared in its own task, which returns a
    spanning forest rather than pairs: no link is lost and no task holds more
    than two tiles of a key.
    """
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    known = cut(nodes.filter("rep is not null"))  # a fingerprint that only null ids have links no ids
    masks = [a | b for a, b in combinations(_blocks(max_bits + 2), 2)]
    listed = known.select(
        "fp", "rep", F.inline(F.array(*[F.struct(F.lit(i).alias("part"),
                                                 F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                                        for i, m in enumerate(masks)])))
    sizes = listed.groupBy("part", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp", "part"), F.col("tiles")).cast("int")
    dealt = (listed.join(sizes, ["part", "bits"]).withColumn("tiles", tiles).withColumn("own", own)
             .select("fp", "rep", "part", "bits", "own",
                     F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
             .select("fp", "rep", "part", "bits", F.least("own", "other").alias("ta"),
                     F.greatest("own", "other").alias("tb")))
    edges = per_key(dealt, ["part", "bits", "ta", "tb"],
                    lambda table, starts: close_links(table, starts, max_bits), "a long, b long")
    found = components(edges)
    of_print = (known.join(found, known.rep == found.node, "left")
                .select("fp", F.coalesce("component", "rep").alias("component")))
    return (prints.join(of_print, "fp", "left")
            .select(F.col("id").alias(id_col),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("component").alias("component_id")))
