"""Collocations, piece encoding and the filter audit against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tests.llm.test_operators import clash, docs_frame
from tidemark.llm import audit, phrases, pieces
from tidemark.llm.queries import PIECES, tokenizer_path

# ---- 11 phrase collocations -----------------------------------------------------------------------


def brute_collocations(rows, min_count, max_words, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    often = {p: a for p, a in f.items() if a >= min_count}
    out = {}
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        inside = any(len(q) - 1 > len(w) and q[0] == lang and b >= a and
                     any(list(q[i:i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, b in often.items())
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])])
                for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s)
            for lang, got in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1)}


def phrase_texts(rng):
    vocab = ["The", "of", "house", "é́", "ΣΑΣ", "x'y", "a|b", "中文", "w9"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" "] * 6 + ["  ", "\t", ", ", ".\n", "!", "\x0b", " "])
                             for _ in range(n))
    texts = [make(rng.randrange(60)) for _ in range(60)]
    hot = "in the beginning was the word and so on. " * 3
    return [None, "", "...", " \n\t", "one", make(4000), hot, hot, hot, *texts]


@pytest.mark.parametrize("min_count,shard_words,shards", [(3, 400, 1), (25, 10**6, 3), (25, 700, 1), (40, 10**6, 32), (1, 10**6, 1)])
def test_collocations_match_brute_force(spark, min_count, shard_words, shards):
    """Supports of many and of fractional occurrences per shard: one round for all lengths, and a round for each."""
    rng = random.Random(min_count)
    texts = phrase_texts(rng)
    if min_count == 1:
        texts = texts[:20]
        texts[5] = "a b a b c"
    langs = [rng.choice(["en", "en", "de", None, ""]) for _ in texts]
    docs = docs_frame(spark, texts, ids=[0] * len(texts), langs=langs).drop("lang").withColumnRenamed("source", "s")
    rows = list(zip(langs, texts))
    docs = clash(spark.createDataFrame([(0, t, g) for g, t in rows], "doc_id long, text string, lang string"))
    for top in (2000, 4):
        got = phrases.collocations(docs, min_count, 5, top, shard_words=shard_words, shards=shards).collect()
        assert {tuple(r) for r in got} == brute_collocations(rows, min_count, 5, top) and len(got) == len({tuple(r) for r in got})
        assert got


def test_collocations_of_nothing(spark):
    assert phrases.collocations(docs_frame(spark, ["a b"]).limit(0)).count() == 0
    assert phrases.collocations(docs_frame(spark, [None, "", "a b c"])).count() == 0


def test_collocation_products_pass_64_bits(spark, monkeypatch):
    """Counts of 10^12 words: the score of a cut is exact where 1000 * a * n needs 90 bits."""
    n, f = 10**12 + 7, {"p q": 10**11 + 3, "p": 3 * 10**11 + 1, "q": 2 * 10**11 + 9}
    known = spark.createDataFrame([("en", p, len(p.split()), a) for p, a in f.items()], "lang string, phrase string, m int, a long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (known, totals))
    (r,) = phrases.collocations(known).collect()
    assert r["score"] == 1000 * f["p q"] * n // (f["p"] * f["q"])


def test_a_shard_counts_whole_pieces_over_slices():
    """Documents cut into slices and words at the edges of documents and batches."""
    import pyarrow as pa
    shard = phrases._Shard()
    shard.SLICE, shard.TURN = 5, 2
    texts = ["ab cd", "cd", None, "", "ab", " cd ab", "ab.cd ef"]
    shard.add(pa.array(["x"] * 7), pa.array(texts))
    got = {}
    for k, _, text, counts, _ in shard.levels(5, lambda k, c, h: np.ones(len(c), bool)):
        got |= dict(zip(text.cast(pa.string()).to_pylist(), counts))
    assert got == {"ab": 4, "cd": 4, "ef": 1, "ab cd": 1, "cd ab": 1, "cd ef": 1}


def test_shards_send_blocks_that_add_up_by_text():
    """A row per part and language whatever the number of phrases; sums over shards are exact, rare phrases stay behind."""
    import pyarrow as pa
    rng = random.Random(3)
    want, tables, sent = Counter(), [], 0
    for _ in range(3):
        shard = phrases._Shard()
        rows = [(rng.choice(["x", None, ""]), " ".join(rng.choice(["\u00e9", "b|", "it's", "\u4e2d"]) for _ in range(30))) for _ in range(40)]
        shard.add(pa.array([g for g, _ in rows]), pa.array([t for _, t in rows]))
        for g, t in rows:
            w = t.split(" ")
            want.update(("und" if g is None else g, " ".join(w[i:i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
        for _, lang, text, counts, h in shard.levels(3, lambda k, c, h: np.ones(len(c), bool)):
            tables.append(phrases._blocks(lang, text, counts, h, 4))
            assert tables[-1].num_rows <= 4 * 3
            sent += len(counts)
    blocks, got = pa.Table.from_batches(tables), {}
    assert sent > 5 * blocks.num_rows
    for part in range(4):
        for lang in ("x", "und", ""):
            own = blocks.filter((pa.compute.field("part") == part) & (pa.compute.field("lang") == lang))
            for r in phrases._add_up(own, lang, 50).to_pylist() if own.num_rows else []:
                assert (lang, r["phrase"]) not in got and r["m"] == len(r["phrase"].split(" "))
                got[lang, r["phrase"]] = r["a"]
    assert got == {p: a for p, a in want.items() if a >= 50} and 0 < len(got) < len(want)


# ---- 12 piece encoding ----------------------------------------------------------------------------

def odd_pieces():
    rng = random.Random(12)
    alphabet = "aeinrst  \n\t▁ABé́中ﬁ😀0123.,'\u0000 ​<s>"
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    return [None, "", " ", "   ", "▁", "▁▁ a▁b", "a\nb\n\n c", "x" * 5000, " " * 3000 + "end", "ab" * 3000, "é" * 500,
            "<s> </s> <unk> <0x0A>", "same", "same", " ﻿", "İ ALİ. 𝒳", *noise]


def test_agenda_equals_the_library(spark):
    enc = pieces.encoder(tokenizer_path(PIECES))
    for text in odd_pieces():
        text = text or ""
        want = enc.library.encode(text)
        assert enc.ids([text])[0].tolist() == want, text[:60]
        # without cutting the text into segments first
        whole = b"".join(enc.coded.get(p) or enc._unknown(p) for p in enc.merge(enc.library.normalize(text)))
        assert np.frombuffer(whole, "<u4").tolist() == want, text[:60]
    texts = [t or "" for t in odd_pieces()]
    assert [x.tolist() for x in enc.ids(texts)] == enc.library.encode(texts) and enc.ids([]) == []
    docs = docs_frame(spark, odd_pieces(), ids=[None, 0, 0, *range(len(odd_pieces()) - 3)])
    rows = pieces.encode(docs, tokenizer_path(PIECES)).collect()
    assert len(rows) == len(odd_pieces()) and all(r["agrees"] for r in rows)
    assert Counter((r["id"], tuple(r["ids"]), r["decoded"]) for r in rows) == Counter(
        (i, tuple(enc.library.encode(t or "")), enc.library.decode(enc.library.encode(t or "")) if t else "")
        for i, t in zip([None, 0, 0, *range(len(odd_pieces()) - 3)], odd_pieces()))
    assert pieces.encode(docs.limit(0), tokenizer_path(PIECES)).count() == 0


def test_a_forgetful_encoder_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(pieces.Encoder, "KEEP", 2)
    enc = pieces.Encoder(tokenizer_path(PIECES))
    text = "the house of the rising sun " * 20
    for _ in range(3):
        assert enc.ids([text, text[5:]])[0].tolist() == enc.library.encode(text) and len(enc.seen) <= 2


def test_unused_pieces_fall_back_and_unknown_ones_join():
    """A vocabulary with unused pieces and no bytes, set up by hand."""
    enc = pieces.Encoder(tokenizer_path(PIECES))
    enc.learn({"a": (1, 0.0), "b": (2, 0.0), "c": (3, 0.0), "ab": (4, -1.0), "abc": (5, -2.0), "bc": (6, -0.5)}, {"abc", "bc"})
    enc.unknown, enc.bytes = 0, None
    # bc is merged first, then abc: both are unused and fall back to single pieces
    assert enc.merge("abc") == ["a", "b", "c"] and enc.merge("abab") == ["ab", "ab"]
    # runs of unknown pieces are one, the spaces too
    assert [x.tolist() for x in enc.ids(["zzabz z", "", "zz"])] == [[0, 4, 0], [], [0]]


def test_cuts_are_safe_for_any_vocabulary():
    """Vocabularies with spaces inside pieces, letters before other characters, and neither."""
    rng = random.Random(7)
    for extra in ([], ["a▁b"], ["b,"], ["a▁b", "b,", ",a"]):
        enc = pieces.Encoder(tokenizer_path(PIECES))
        made = [*"▁ab,c", "ab", "▁a", "▁▁", ",,", ",a", "▁ab", "bb", *extra]
        enc.learn({p: (i, float(-len(p) if i % 3 else -2)) for i, p in enumerate(dict.fromkeys(made))}, set())
        for _ in range(300):
            text = "".join(rng.choice("▁▁ab,cz") for _ in range(rng.randrange(1, 30)))
            cut, first = enc.segments([text, text[:3]])
            cut = cut.to_pylist()
            assert "".join(cut[:first[1]]) == text and "".join(cut[first[1]:]) == text[:3]
            assert [p for s in cut[:first[1]] for p in enc.merge(s)] == enc.merge(text), (extra, text)


def test_other_kinds_of_models_are_refused(monkeypatch):
    monkeypatch.setattr(pieces, "MERGES", 1)
    with pytest.raises(ValueError):
        pieces.Encoder(tokenizer_path(PIECES))


# ---- 13 filter audit ------------------------------------------------------------------------------

def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    facts = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i)
        facts.append((lang or "", f, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {p for p, *_ in facts}:
        for order in permutations(range(5)):
            left, gone = [x for x in facts if x[0] == part], []
            for step, k in enumerate(order, 1):
                removed = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                shapley[part, k] += len(removed)
                out.append((part, order, step, len(left), len(removed), sum(x[1][k] for x in gone),
                            sum(x[1][k] and sum(x[1]) == 1 for x in facts if x[0] == part),
                            sum(x[2] for x in removed), sum(x[3] for x in removed)))
                gone += removed
    return {(p, "".join("ABCDE"[k] for k in o), s, *rest, shapley[p, o[s - 1]]) for p, o, s, *rest in out}


def test_audit_matches_brute_force(spark):
    rng = random.Random(13)
    w = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [None, "", "", " \n", "AB", "A" + "b" * 9, "A" + "b" * 8, w(99, 900), w(100, 900), w(100, 20), w(300, 10**6),
             " ".join(f"v{i % 80}" for i in range(100)), " ".join(f"v{i % 79}" for i in range(100)), w(20000, 10**6),
             "a b\x1cc", "x # y", w(120, 10**6) + " 100%", w(120, 10**6).upper(), "Ä" * 50]
    texts += [texts[10]] * 5 + [texts[9]] * 3 + [rng.choice(texts) for _ in range(60)]
    ids = [*range(len(texts) - 4), 3, None, None, 9]  # repeated and missing ids
    langs = [rng.choice(["en", "de", None, ""]) for _ in texts]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, len(texts), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10**9, 1, 1)]
    docs = clash(spark.createDataFrame(list(zip(ids, texts, langs)), "doc_id long, text string, lang string"))
    marks = clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [tuple(r) for r in audit.audit(docs, marks).collect()]
    want = brute_audit(list(zip(ids, texts, langs)), labels)
    assert len(got) == len(want) == 600 * 3 and set(got) == want
    assert audit.audit(docs.limit(0), marks).count() == 0
    none = audit.audit(docs, marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(none) == (0, 0)


def test_contract_sums():
    """Removed and kept add up over an order, and the five shares add up to 120 times all that is removed."""
    counts = np.random.default_rng(1).integers(0, 50, (3, 2, 2, 2, 2, 2))
    rows = audit.contract(counts)
    total, clean = counts[0].sum(), counts[0, 0, 0, 0, 0, 0]
    by_order = {}
    for r in rows:
        by_order.setdefault(r[0], []).append(r)
    for own in by_order.values():
        assert own[-1][2] == clean and sum(r[3] for r in own) == total - clean
    assert sum({r[0][r[1] - 1]: r[-1] for r in rows}.values()) == 120 * (total - clean)
