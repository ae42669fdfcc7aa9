"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier per bit tells the n-grams
of the languages that have the bit from those of the others. A text's bits are
decoded to the codeword with the smallest weighted loss, and the distance to
the next codeword flags ambiguous texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_split

BUCKETS = 1 << 13     # hashed byte trigrams
SHRINK = 200.0        # trigrams beyond which more text adds no certainty
AMBIGUOUS = 0.4       # score below which a decision is flagged
SLICE = 1 << 20       # bytes of a text handled at a time

# ASCII letters stay, any other ASCII byte becomes a space; bytes of longer characters stay.
_LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(any(map(str.isalpha, m.group())) for m in _WORD.finditer(text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of the lower-cased text's UTF-8 bytes."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw) - 2, SLICE):
        b = np.frombuffer(raw[at:at + SLICE + 2], np.uint8).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        out += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(19), minlength=BUCKETS)
    return out


def code_matrix(k: int) -> np.ndarray:
    """Codewords (rows, +1/-1) of ``k`` languages.

    Up to 7 languages: all 2^(k-1) - 1 different splits. More: the best of many
    random codes of 10 log2(k) bits by the smallest distance of two codewords.
    """
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        cols = [[1.0] + [1.0 if s >> i & 1 else -1.0 for i in range(k - 1)] for s in range(2 ** (k - 1) - 1)]
        return np.array(cols).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(k)))
    best, width = None, -1.0
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, bits))
        d = (bits - m @ m.T) / 2 + np.eye(k) * bits
        if d.min() > width and (np.abs(m.sum(0)) < k).all():
            best, width = m, d.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits: log odds of a trigram
    trust: np.ndarray     # weight of each bit's loss


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          split: tuple[int, int] = (4, 2)) -> Model:
    """Fit on all rows with a language whose crc32(id) mod ``split[0]`` is not ``split[1]``.

    Spark adds the trigram counts per language over every such text; the
    driver gets one row per language and bucket (at most BUCKETS rows for each
    language). A bit's classifier is the log odds of each trigram between the
    two sides, every language weighing the same; its trust is the divergence
    of the two sides.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                if text:
                    sums[lang] += ngram_counts(text)
        for lang, n in sums.items():
            at = np.append(np.flatnonzero(n), 0)[: max(1, np.count_nonzero(n))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                ["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull() & ~in_split(id_col, *split)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    table = (rows.mapInArrow(run, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    code = code_matrix(len(langs))
    p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if len(langs) else counts
    weights, trust = np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1])
    for b in range(code.shape[1] if len(langs) > 1 else 0):
        one, zero = p[code[:, b] > 0].mean(0), p[code[:, b] < 0].mean(0)
        weights[:, b] = np.log(one / zero)
        trust[b] = ((one - zero) * weights[:, b]).sum()
    return Model(langs, code, weights.astype(np.float32), trust / max(trust.sum(), 1e-9))


def decode(model: Model, text: str | None) -> tuple[str, float, str, bool]:
    """(language, score, runner-up, ambiguous) of one text."""
    if not model.langs or not has_letter(text):
        return "und", 0.0, "und", True
    n = ngram_counts(text)
    total = n.sum()
    # log odds per trigram, times the trigrams that count as evidence
    margin = (n @ model.weights) / total * (total * SHRINK / (total + SHRINK))
    loss = (np.logaddexp(0.0, -model.code * margin) * model.trust).sum(1)
    order = np.argsort(loss, kind="stable")
    p = np.exp(loss.min() - loss)
    score = float(p.max() / p.sum())
    return (model.langs[order[0]], score, model.langs[order[1]] if len(order) > 1 else "und", score < AMBIGUOUS)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, runner_up, ambiguous) of every row of ``docs``, from the text alone.

    ``und`` with score 0 if the text is null or has no letter, or if no
    language was learned. Whole texts count, whatever their length; equal
    texts get equal results; a tie goes to the first language by name.
    """
    schema = f"{id_col} long, lang_pred string, score double, runner_up string, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = [decode(model, t.as_py()) for t in batch.column(1)]
            cols = list(zip(*got)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in
                                    zip(cols, (pa.string(), pa.float64(), pa.string(), pa.bool_())))],
                [id_col, "lang_pred", "score", "runner_up", "ambiguous"])
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
