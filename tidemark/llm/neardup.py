"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors, less their mean direction, by the concatenated
signs of its own random projections and compares every vector with a bounded window of its
neighbours in that order. Verified pairs of all passes are united into
components; inside a component the exact number of links is then counted in
tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, cut, forest, partitions, per_key

PASSES, BITS, WINDOW = 12, 62, 24  # fewest passes; needed_passes() adds more as the table grows
RECALL = 0.99  # chance that a lone pair right at the threshold meets in some window
PROBES = 2  # passes over which the runs of equal code prefixes are measured first
STEPS, STEP = 400, 0.05  # classes of the measure, in natural logarithms of the chance to meet
TILE = 512  # vectors of a component compared at a time
SPAN = 64  # windows in a range partition at least: its border cuts off one of them


def needed_passes(n: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at ``threshold`` has met with probability ``recall`` among ``n`` vectors.

    Two such vectors agree on a sign with probability p = 1 - acos(threshold) / pi.
    They stand within a window once their codes share the log2(n / window)
    leading bits that split the table into window-sized runs.
    """
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = p ** math.log2(max(n / window, 1))
    return PASSES if meet >= recall else max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def passes_for(classes: np.ndarray, recall: float = RECALL) -> int:
    """Passes after which lone pairs of the measured rows have met.

    ``classes[k]`` rows meet a partner at the threshold with a chance of
    exp(-k * STEP) a pass. On average over the rows a share of ``recall`` has
    met, and of the rows at the 99th percentile of k 0.95.
    """
    if not classes.sum():
        return PASSES
    share, meet = classes / classes.sum(), np.exp(-STEP * np.arange(len(classes)))
    meet[0] = np.exp(-STEP / 2)
    worst = meet[np.searchsorted(np.cumsum(share), 0.99)]
    need = max(PASSES, math.ceil(math.log(0.05) / math.log1p(-worst)))
    while share @ (1 - meet) ** need > 1 - recall and need < 1 << 24:
        need = math.ceil(need * 1.05)
    return need


def _chances(batches: Iterator[pa.RecordBatch], window: int, threshold: float, fmt: str,
             means: dict[int, np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """(class, rows): the chance that a row in code order meets a partner at the threshold in a window.

    A partner is met if it shares the prefix that splits the row from the one
    ``window`` places on. Rows that are linked with most of their window are
    left out: a group of near copies is united by these links.
    """
    classes = np.zeros(STEPS, np.int64)
    tail: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*tail, batch]).combine_chunks()
        part, code = (table.column(c).to_numpy() for c in ("part", "code"))
        raw = table.column("vec").to_pylist()
        for own in _same_width(raw):
            if len(own) <= window:
                continue
            x = np.stack(_unit([raw[i] for i in own], fmt))
            at, to = own[:-window], own[window:]
            links = sum(np.einsum("ij,ij->i", x[:-window], x[d:len(x) - window + d]) >= threshold
                        for d in range(1, window + 1))
            low = np.frexp((code[at] ^ code[to]).astype(np.float64))[1]  # bits from the first that differs
            depth = np.minimum(bits, bits - low + 1)
            radius = ((x[:-window] - means[x.shape[1]]) ** 2).sum(axis=1)
            agree = 1 - np.arccos(np.clip(1 - (1 - threshold) / np.maximum(radius, 1e-9), -1, 1)) / np.pi
            lost = -depth * np.log(np.maximum(agree, 1e-9))
            lone = (part[at] == part[to]) & (links * 2 < window)
            classes += np.bincount(np.minimum(lost[lone] / STEP, STEPS - 1).astype(int), minlength=STEPS)
        tail = table.slice(max(0, table.num_rows - window)).to_batches()
    k = np.flatnonzero(classes)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(classes[k])], ["class", "rows"])


def _unit(raw: list[bytes], fmt: str) -> list[np.ndarray]:
    wide = [np.frombuffer(x, fmt).astype("<f8") for x in raw]
    return [x / np.linalg.norm(x) for x in wide]


def _same_width(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Row numbers by vector width: vectors of different widths have no cosine."""
    width = np.fromiter(map(len, raw), np.int64, len(raw))
    for w in np.unique(width):
        yield np.flatnonzero(width == w)


def _windows(batches: Iterator[pa.RecordBatch], window: int, threshold: float, fmt: str) -> Iterator[pa.RecordBatch]:
    """Verified links of rows in (pass, code) order with the ``window`` rows after them, as forests of each slice."""
    tail: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*tail, batch]).combine_chunks()
        part, rep, raw = (table.column(c).to_pylist() for c in ("part", "rep", "vec"))
        part, rep = np.array(part), np.array(rep, np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in _same_width(raw):
            x = np.stack(_unit([raw[i] for i in own], fmt))
            for d in range(1, min(window, len(own) - 1) + 1):
                near = (np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold) & (part[own][:-d] == part[own][d:])
                a.append(own[:-d][near])
                b.append(own[d:][near])
        lab = forest(len(rep), np.concatenate(a), np.concatenate(b))
        at = np.flatnonzero(lab != np.arange(len(rep)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[lab[at]])], ["a", "b"])
        tail = table.slice(max(0, table.num_rows - window)).to_batches()


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, passes: int | None = None,
                    bits: int = BITS, window: int = WINDOW, seed: int = 11, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Linked are vectors whose cosine in double precision is ``threshold`` or
    more; component_id is the smallest id reachable over links. Null, empty
    and zero vectors and those with null or non-finite components link with
    nothing; vectors of different widths never link. Equal vectors are one
    node with a count, so copies are not paired; rows with equal ids keep a
    row each; an empty table gives an empty result; other columns are not read.

    Two vectors at the threshold agree on a projection's sign with
    probability 0.9 (0.97 at cosine 0.995), and every pass is a new order, so a
    pair that one pass keeps apart meets in another; windows bound the work to
    passes * window comparisons a vector. Without ``passes`` their number
    follows from the count of different vectors (``needed_passes``) and, where
    many of them share long code prefixes, from the runs measured in PROBES
    passes (``passes_for``), up to the count divided by the window: so many
    passes are as much work as all pairs. Windows end where a range partition
    ends, so a partition holds SPAN windows or more, however many shuffle
    partitions the session asks for. Inside a found component all pairs
    are counted exactly, in tiles of TILE vectors: groups larger than any
    window lose no link, and no task holds more than two tiles.
    """
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    fmt = "<f4" if single else "<f8"  # on the way through the passes; cosines are in double precision either way
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    big = F.array_max(F.transform("x", F.abs))
    ok = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall(
        "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (big > 0)
    # scaled by a power of two, so that no square overflows or vanishes and the cosine is unchanged;
    # squares of single-precision values never do
    scaled = F.col("x") if single else F.transform("x", lambda v: v / F.pow(F.lit(2.0), F.floor(F.log2(big))))
    rows = cut(rows.select("id", F.when(F.coalesce(ok, F.lit(False)), scaled).alias("x")))
    nodes = cut(rows.filter("x is not null and id is not null").groupBy("x")
                .agg(F.min("id").alias("rep"), F.count("*").alias("copies")))

    def totals(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for v in batch.column(0):
                x = np.asarray(v.as_py(), "<f8")
                x = np.append(x / np.linalg.norm(x), 1.0)
                sums[len(x) - 1] = sums.get(len(x) - 1, 0) + x
        for width, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, width, np.int32)),
                                              pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(x)],
                                             ["width", "at", "total"])

    # the driver gets one number a dimension
    summed = (nodes.select("x").mapInArrow(totals, "width int, at int, total double")
              .groupBy("width", "at").agg(F.sum("total").alias("total")).orderBy("width", "at").collect())
    means: dict[int, np.ndarray] = {}
    for width in {r["width"] for r in summed}:
        x = np.array([r["total"] for r in summed if r["width"] == width])
        means[width] = x[:-1] / x[-1]

    def code(batches: Iterator[pa.RecordBatch], passes: int):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            rep, vecs = batch.column(0), batch.column(1)
            raw = [np.asarray(v.as_py(), "<f8") for v in vecs]
            got = np.zeros((len(raw), passes), np.int64)
            for i, v in enumerate(raw):
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([seed, len(v)]).normal(size=(passes * bits, len(v)))
                own = v / np.linalg.norm(v) - means[len(v)]
                got[i] = ((planes[len(v)] @ own).reshape(passes, bits) > 0) @ weights
            data = [v.astype(fmt).tobytes() for v in raw]
            for p in range(passes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(raw), p, np.int32)), pa.array(got[:, p]), rep, pa.array(data, pa.binary())],
                    ["part", "code", "rep", "vec"])

    def ordered(passes: int) -> DataFrame:
        coded = nodes.select("rep", "x").mapInArrow(lambda batches: code(batches, passes),
                                                    "part int, code long, rep long, vec binary")
        parts = max(1, min(partitions(vectors), n * passes // (SPAN * window)))
        return (coded.repartitionByRange(parts, "part", "code", "rep")
                .sortWithinPartitions("part", "code", "rep"))

    n = nodes.count()
    if not passes:
        passes, most = needed_passes(n, threshold, window), math.ceil(n / window)
        if most > passes:
            found = (ordered(PROBES).mapInArrow(lambda batches: _chances(batches, window, threshold, fmt, means, bits),
                                                "class long, rows long")
                     .groupBy("class").agg(F.sum("rows").alias("rows")).collect())
            classes = np.zeros(STEPS, np.int64)
            for r in found:
                classes[r["class"]] = r["rows"]
            passes = max(passes, min(passes_for(classes), most))

    edges = ordered(passes).mapInArrow(lambda batches: _windows(batches, window, threshold, fmt), "a long, b long")
    found = cut(components(edges))
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))

    def count(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rep, copies = (table.column(c).to_numpy() for c in ("rep", "copies"))
        own, vecs = table.column("own").to_numpy(), table.column("x").to_pylist()
        ta, tb = (table.column(c).to_numpy() for c in ("ta", "tb"))
        links = np.zeros(len(rep), np.int64)
        for s, e in zip(starts[:-1], starts[1:]):
            raw = [np.asarray(v, "<f8") for v in vecs[s:e]]
            for same in _same_width([v.tobytes() for v in raw]):
                x = np.stack([raw[i] / np.linalg.norm(raw[i]) for i in same])
                at, c = same + s, copies[same + s]
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                # in a task of two tiles only pairs across them are new
                if ta[s] != tb[s]:
                    near &= own[at][:, None] != own[at][None, :]
                links[at] = near @ c
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], ["rep", "links"])

    dealt = (found.join(nodes, found.node == nodes.rep).join(sizes, "component")
             .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
             .select("component", "rep", "copies", "x", "own",
                     F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
             .withColumn("ta", F.least("own", "other")).withColumn("tb", F.greatest("own", "other")).drop("other"))
    counted = (per_key(dealt, ["component", "ta", "tb"], count, "rep long, links long")
               .groupBy("rep").agg(F.sum("links").alias("links")))
    labels = (nodes.join(found, nodes.rep == found.node, "left").join(counted, "rep", "left")
              .select("x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    linked = rows.join(labels, "x", "left")
    component = F.coalesce("component_id", "id")
    return linked.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                         component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
