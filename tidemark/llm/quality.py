"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention
network (Ilse et al., 2018) weighs the passages, and the weighted mean of
their encodings is scored. Only the document's label is known in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_split

PASSAGE_WORDS = 64
HASHED = 128            # hashed byte pairs per passage
SURFACE = 13
FEATURES = SURFACE + HASHED
HIDDEN, GATE = 24, 12
SAMPLE_PER_CLASS = 2000  # bound of the training sample: documents of each label
MAX_PASSAGES = 512   # passages of a training document; scores always take all of them
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.005, 1e-3

_KIND = np.zeros(256, np.uint8)  # 0 other ASCII mark, 1 upper, 2 lower, 3 digit, 4 space, 5 stop or comma, 6 other
for _b in range(256):
    _KIND[_b] = (1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 else 3 if 48 <= _b <= 57 else
                 4 if _b in b" \t\n\r\v\f" else 5 if _b in b".," else 6 if _b > 127 else 0)


def passages(text: str | None) -> np.ndarray:
    """Feature rows (float32) of the text's passages: as few as possible of at most PASSAGE_WORDS words,
    their sizes at most one apart. An empty text has one zero row."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(words) // PASSAGE_WORDS)
    cuts = [len(words) * i // n for i in range(n + 1)]
    out = np.zeros((n, FEATURES), np.float32)
    for at in range(0, n, 512):  # long texts in slices
        own = cuts[at:at + 513]
        _features([words[s:e] for s, e in zip(own, own[1:])], out[at:at + 512])
    return out


def _features(parts: list[list[str]], out: np.ndarray) -> None:
    raw = list(map(" ".join, parts))
    data = [r.encode("utf-8", "surrogatepass") for r in raw]
    size = np.array([len(d) for d in data])
    b = np.frombuffer(b"".join(data), np.uint8)
    row = np.repeat(np.arange(len(data)), size)
    kinds = np.bincount(row * 7 + _KIND[b], minlength=7 * len(data)).reshape(-1, 7)
    out[:, :7] = kinds / size[:, None]
    for i, w in enumerate(parts):
        n, low = len(w), [x.lower() for x in w]
        out[i, 7:SURFACE] = (len(set(low)) / n, sum(map(str.__eq__, low, low[1:])) / n, len(raw[i]) / n / 10,
                             sum(map(str.isalpha, w)) / n, sum(map(str.isupper, w)) / n,
                             sum(len(x) == 1 for x in w) / n)
    pair = (b[:-1].astype(np.uint32) * 31 + b[1:]) * np.uint32(0x9E3779B1) >> np.uint32(25)
    same = row[:-1] == row[1:]
    grams = np.bincount(row[:-1][same] * HASHED + pair[same].astype(np.int64), minlength=HASHED * len(data))
    out[:, SURFACE:] = np.sqrt(grams.reshape(-1, HASHED) / size[:, None])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    shift: float  # log odds of the labels' own shares against those of the sample


def _forward(p, x, starts, bag):
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["a"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    att = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(h * att[:, None], starts, axis=0)
    return h, t, s, att, z, z @ p["c"] + p["d"]


def _gradient(p, x, starts, bag, y, w):
    h, t, s, att, z, logit = _forward(p, x, starts, bag)
    err = (1 / (1 + np.exp(-logit)) - y) * w / w.sum()
    gz = err[:, None] * p["c"]
    g_att = (h * gz[bag]).sum(1)
    g_e = att * (g_att - np.add.reduceat(att * g_att, starts)[bag])
    gh = att[:, None] * gz[bag]
    gt, gs = g_e[:, None] * p["a"] * s * (1 - t * t), g_e[:, None] * p["a"] * t * s * (1 - s)
    gh += gt @ p["V"].T + gs @ p["U"].T
    gx = gh * (1 - h * h)
    return {"W": x.T @ gx, "b": gx.sum(0), "V": h.T @ gt, "U": h.T @ gs, "a": (t * s).T @ g_e,
            "c": z.T @ err, "d": err.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, shift: float = 0.0, seed: int = 5) -> Model:
    """Adam on the cross entropy of the documents' labels; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    allx = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    mean, scale = allx.mean(0), allx.std(0) + 0.02
    p = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "a": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "d": np.zeros(())}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = max(labels.mean(), 1e-9) if len(labels) else 0.5
    if not 0 < share < 1:  # one label only: the score says just that
        return Model(mean, scale, p | {"c": np.zeros(HIDDEN), "d": np.array(np.sign(share - 0.5) * 3.0)}, shift)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            n = np.array([len(bags[i]) for i in own])
            starts, bag = np.cumsum(n) - n, np.repeat(np.arange(len(own)), n)
            x = (np.concatenate([bags[i] for i in own]) - mean) / scale
            g = _gradient(p, x, starts, bag, labels[own], weight[own])
            step += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, p, shift)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", split: tuple[int, int] = (5, 0),
          per_class: int = SAMPLE_PER_CLASS, max_passages: int = MAX_PASSAGES) -> Model:
    """Fit on labelled rows whose crc32(id) mod ``split[0]`` is not ``split[1]``.

    The sample is bounded by ``per_class`` documents of each label, the first
    by a hash of the id, and by ``max_passages`` of each, spread evenly over the
    text. Repeated label rows count once, and of the rows of one id the
    smallest text is learned from. Texts are encoded on the executors and
    only passage features reach the driver. The score's prior is the share of
    the labels over all training rows. Null labels and ids are not learned
    from; without any label every score is 0.5.
    """
    own = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
           .filter("id is not null and y in (0, 1)").filter(~in_split("id", *split)).distinct())
    share = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bags = [passages(t.as_py()) for t in batch.column(2)]
            # a longer bag is thinned out evenly
            bags = [x if len(x) <= max_passages else x[np.linspace(0, len(x) - 1, max_passages).astype(int)] for x in bags]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in bags], pa.binary())], ["id", "y", "x"])

    # at most 2 * per_class rows of max_passages passages each: bounded by the parameters
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
             .join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    rows = texts.mapInArrow(run, "id long, y int, x binary").toPandas().sort_values(["id", "y", "x"])
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in rows["x"]]
    both = len(share) == 2
    shift = float(np.log(share[1] / share[0])) if both else 0.0
    if not bags:
        return fit([np.zeros((1, FEATURES), np.float32)] * 2, np.array([0.0, 1.0]))
    return fit(bags, rows["y"].to_numpy(float), shift)


def score_text(model: Model, text: str | None) -> float:
    x = (passages(text) - model.mean) / model.scale
    logit = _forward(model.p, x, np.zeros(1, np.int64), np.zeros(len(x), np.int64))[-1][0] + model.shift
    return float(1 / (1 + np.exp(-logit)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row of ``docs``, from its whole text alone.

    Null and empty texts are bags of one empty passage and get the score that
    the model gives it; equal texts get equal scores.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = np.array([score_text(model, t.as_py()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                [id_col, "score", "predicted"])
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"{id_col} long, score double, predicted int")
