"""Language ID and the quality score against plain versions; projection passes under many shuffle partitions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import brute_links, clash, docs_frame, reach
from tidemark.llm import langid, neardup, quality

SF = "/root/testdata/sf0.001"


def grams(text):
    """Hashed trigrams of the lower-cased text, one by one."""
    raw = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in text.lower().encode())
    raw, mask, out = b" " + b" ".join(raw.split()) + b" ", (1 << 32) - 1, Counter()
    for x, y, z in zip(raw, raw[1:], raw[2:]):
        h = (x * 0x9E3779B1 & mask) ^ (y * 0x85EBCA6B & mask) ^ (z * 0xC2B2AE35 & mask)
        out[(h * 0x27D4EB2F & mask) >> 19] += 1
    return out


def test_language_equals_a_plain_decoder(spark):
    """All documents of sf0.001: the same language and score from counts, codewords and losses worked out in dictionaries."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    sums = {}
    for i, text, lang in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums.setdefault(lang, Counter()).update(grams(text or ""))
    langs = sorted(sums)
    share = {g: [(sums[g][b] + 0.5) / (sum(sums[g].values()) + 0.5 * langid.BUCKETS) for b in range(langid.BUCKETS)] for g in langs}
    code = langid.code_matrix(len(langs)).tolist()
    bits, odds, trust = range(len(code[0])), [], []
    for k in bits:
        sides = [[share[g] for g, word in zip(langs, code) if (word[k] > 0) == side] for side in (True, False)]
        one, zero = ([sum(v) / len(side) for v in zip(*side)] for side in sides)
        odds.append([math.log(a / b) for a, b in zip(one, zero)])
        trust.append(sum((a - b) * o for a, b, o in zip(one, zero, odds[-1])))
    soft = lambda v: max(v, 0) + math.log1p(math.exp(-abs(v)))
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in langid.predict(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert model.langs == langs and len(got) == len(docs) > 50
    for i, text, _ in docs:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        mine = grams(text)
        total = sum(mine.values())
        margin = [langid.SHRINK * sum(n * odds[k][b] for b, n in mine.items()) / (total + langid.SHRINK) for k in bits]
        loss = [sum(t / sum(trust) * soft(-word[k] * margin[k]) for k, t in zip(bits, trust)) for word in code]
        best = min(range(len(langs)), key=loss.__getitem__)
        assert got[i]["lang_pred"] == langs[best]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), abs=1e-4)


def test_quality_equals_a_plain_forward_pass(spark):
    """Passages, gates, attention and score worked out one number at a time."""
    rng = np.random.default_rng(4)
    p = {"W": rng.normal(size=(quality.FEATURES, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)),
         "U": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3), "d": np.array(0.2)}
    mean, scale = rng.normal(size=quality.FEATURES) * 0.1, rng.uniform(0.5, 2, quality.FEATURES)
    model = quality.Model(mean, scale, p, 0.7)
    texts = ["a", "Aa aa AA 12 x, y. \u00e9t\u00e9 !", "word " * 64, "one Two three " * 90, "z" * 3000, "", None, " \n "]
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def features(words):
        raw = " ".join(words)
        data, low = raw.encode(), [w.lower() for w in words]
        kinds = [lambda c: not (chr(c).isalnum() or c in b" \t\n\r\v\f.," or c > 127), lambda c: 65 <= c <= 90,
                 lambda c: 97 <= c <= 122, lambda c: 48 <= c <= 57, lambda c: c in b" \t\n\r\v\f", lambda c: c in b".,",
                 lambda c: c > 127]
        n = len(words)
        out = [sum(map(f, data)) / len(data) for f in kinds]
        out += [len(set(low)) / n, sum(a == b for a, b in zip(low, low[1:])) / n, len(raw) / n / 10]
        out += [sum(map(f, words)) / n for f in (str.isalpha, str.isupper, lambda w: len(w) == 1)]
        pairs = Counter(((x * 31 + y) * 0x9E3779B1 & 0xFFFFFFFF) >> 25 for x, y in zip(data, data[1:]))
        return out + [math.sqrt(pairs[i] / len(data)) for i in range(quality.HASHED)]

    def plain(text):
        words = (text or "").split()
        n = max(1, -(-len(words) // quality.PASSAGE_WORDS))
        parts = [words[len(words) * i // n:len(words) * (i + 1) // n] for i in range(n)]
        hidden, gate = [], []
        for part in parts:
            x = [(f - m) / s for f, m, s in zip(features(part) if part else [0] * quality.FEATURES, mean, scale)]
            h = [math.tanh(sum(x[i] * p["W"][i][j] for i in range(len(x))) + p["b"][j]) for j in range(3)]
            dot = lambda k, j: sum(h[i] * p[k][i][j] for i in range(3))
            gate.append(math.exp(sum(math.tanh(dot("V", j)) * sigmoid(dot("U", j)) * p["a"][j] for j in range(2))))
            hidden.append(h)
        z = [sum(g / sum(gate) * h[j] for g, h in zip(gate, hidden)) for j in range(3)]
        return sigmoid(sum(a * b for a, b in zip(z, p["c"])) + float(p["d"]) + 0.7)

    got = {r["doc_id"]: r for r in quality.score(docs_frame(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        want = plain(text)
        assert got[i]["score"] == pytest.approx(want, abs=1e-5), text
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_embedding_links_do_not_depend_on_the_shuffle_partitions(spark, monkeypatch):
    """Lone pairs near the threshold: the same links when the session asks for thousands of partitions."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(300, 24))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    vecs = [list(map(float, v)) for v in np.concatenate([base, 0.955 * base + math.sqrt(1 - 0.955 ** 2) * side])]
    df = clash(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>"))
    links = brute_links(vecs)
    monkeypatch.setattr(neardup, "partitions", lambda _: 4000)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert {i: got[i]["n_links"] for i in got} == {i: len(x) for i, x in enumerate(links)}
    assert [got[i]["component_id"] for i in range(len(vecs))] == reach(links)
