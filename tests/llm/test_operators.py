"""Each operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, html, langid, neardup, packing, quality, sharding, simhash, urls
from tidemark.llm.common import components
from tidemark.llm.queries import SPECIAL, op6, tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "fp", "rep", "grp", "bin", "size", "part", "pos", "rid", "n", "key", "score", "window", "component",
         "shard", "sid", "released", "own", "x", "kind", "host", "capture_id", "action")


def clash(df):
    """Extra columns with the names that the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def docs_frame(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
    return clash(spark.createDataFrame(rows, DOC))


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return [None, "", " \n\t ", "one", "Two words", "é́ ﬁ İstanbul ΣΑΣ ςa don't <|endoftext|> a_b ½x", "x" * 30000,
            words(rng, 60000), "same text here", "same text here", "42 %%% !!", "a, b. c! d"]


# ---- components -------------------------------------------------------------------------------

def test_components_chain_star_and_none(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(600, 900)]
    e = spark.createDataFrame([*chain, *star, (7, 7), (900, 901), (901, 900)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 500 for i in range(600, 900))
    assert got[901] == 900 and 7 not in got
    assert components(e.limit(0)).count() == 0


# ---- 1 packing ----------------------------------------------------------------------------------

def test_encoder_matches_the_tokenizer(odd_texts):
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(tokenizer_path()), packing._Encoder(tokenizer_path())
    more = ["Ça été, Öl; naïve? RÉSUMÉ 'll it's x's 's", "é ạ̊", "Ünï—cödé… 　 wide space\rtab\t中文 नि",
            "a\x1cb \x85 c", "ſ K Å ǅ ŉ", "0٣x² ᵃ ⅷ"]
    for text in [t for t in odd_texts if t] + more:
        assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text[:40]


def test_encoder_matches_on_random_strings():
    """Marks that join their neighbours, letters that grow in lower case, and 40,000 random strings."""
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(tokenizer_path()), packing._Encoder(tokenizer_path())
    assert enc.known
    rng = random.Random(5)
    odd = "aeinrstABİΣσςéÉ\u0301\u0307\u0345\u0300ﬁßŉǅ\u212a.,!?;:'0½ \n\t中αΑ\u200d"
    wide = [chr(c) for c in range(0x21, 0x3000) if chr(c).isprintable()] + list(".,!?;: ") * 200
    texts = ["ALİ.", "TATİLİ!", "ALİ,", "α\u0345.", "Α\u0345,", "ŉ.", "ǅ,", "<|endoftext|>", "a <|startoftext|>b"]
    texts += ["".join(rng.choice(odd if i % 2 else wide) for _ in range(rng.randrange(1, 14))) for i in range(40_000)]
    assert [t for t in texts if enc.ids(t).tolist() != tok.encode(t, add_special_tokens=False).ids] == []


def test_encoder_parts_marks_and_ascii_without_the_pipeline(monkeypatch):
    """Closing marks, numbers and joined ASCII words go to the model; chunks dropped and kept again give the same ids."""
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(tokenizer_path()), packing._Encoder(tokenizer_path())
    texts = ["It's, we'll... 'tis x'sy '' -'s a_b-c $$$ a$$$ 12,5 \u00c9t\u00e9!! \u00e7a\u2026 <| |> <|end <|endoftext|", "A " * 9 + "b2",
             "\u00e9 DON'T o'Re'Ve ~ [x](y) a<|endoftext|>b, <|endoftext|>", "z" * 300 + "!" * 300 + "7" * 30]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing._Kept, "KEEP", 5)
    asked, full = [], enc._full
    monkeypatch.setattr(enc, "_full", lambda c: asked.append(c) or full(c))
    for _ in range(2):
        assert [enc.ids(t).tolist() for t in texts] == want
        assert len(enc.seen) <= 5 and len(enc.seen.old) <= 5
    assert set(asked) == {"\u00e7a\u2026", "a<|endoftext|>b,", "<|endoftext|>"}


def test_encoder_of_another_file_takes_whole_texts(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = packing._Encoder(path)
    text = "Two  words, ALİ.\n x"
    assert not enc.known and enc.ids(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_rows_without_or_of_one_id_are_dealt_over_the_groups(spark):
    pieces = spark.range(4000).selectExpr("cast(if(id < 2000, null, 7) as long) as id", "0 as piece", "0L as start",
                                          "cast(id % 90 + 1 as long) as length", "cast(5 as long) as ids_crc32")
    rows = packing.pack(pieces, 100, group_pieces=100, fan_in=4).collect()
    assert len(rows) == 4000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4000
    total = Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 100 and len({r["sequence_id"] >> 24 for r in rows if r["sequence_id"] < 1 << 57}) > 20


def test_packing_round_trip(spark, odd_texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    docs = docs_frame(spark, odd_texts, ids=[*range(len(odd_texts) - 1), 0])  # a repeated id
    rows = packing.pack(packing.token_pieces(docs, tokenizer_path(), 64), 64, group_pieces=32, fan_in=4).collect()
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in odd_texts]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    want = Counter((d if d < len(odd_texts) - 1 else 0, at // 64, at, len(own[at:at + 64]),
                    zlib.crc32(np.array(own[at:at + 64], "<u4").tobytes()))
                   for d, own in enumerate(ids) for at in range(0, len(own), 64))
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    lengths = np.array([r["length"] for r in rows])
    assert packing.bin_bound(lengths, 64) <= len(seqs) <= packing.bin_bound(lengths, 64) * 1.02 + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_packing_groups_stay_bounded(spark):
    """Gaps in every bin release nearly all pieces: groups stop growing, and the packing is whole."""
    rng = random.Random(3)
    n = 4000
    pieces = spark.createDataFrame([(i, 0, 0, rng.randint(26, 33), 0) for i in range(n)],
                                   "id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, 100, group_pieces=8, fan_in=2).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    seqs, groups = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        groups[r["sequence_id"] >> 20] = groups.get(r["sequence_id"] >> 20, 0) + 1
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    assert max(groups.values()) < 200  # 16 pieces a group on average, merged by hash


def test_best_fit_and_bounds():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 100, rng.integers(1, 60))
        bins, free = packing.best_fit(n, 100)
        assert (np.bincount(bins, weights=n) + free == 100).all()
        assert -(-n.sum() // 100) <= packing.bin_bound(n, 100) <= len(free)
    assert packing.bin_bound(np.full(10, 51), 100) == 10 == len(packing.best_fit(np.full(10, 51), 100)[1])
    assert packing.bin_bound(np.full(9, 34), 100) == 5 == len(packing.best_fit(np.full(9, 34), 100)[1])


# ---- 2 language ---------------------------------------------------------------------------------

def test_language(spark):
    rng, alpha = random.Random(1), {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    make = lambda g, n: " ".join("".join(rng.choice(alpha[g]) for _ in range(5)) for _ in range(n))
    langs = [rng.choice([*alpha, None]) for _ in range(200)]
    truth = [g or rng.choice([*alpha]) for g in langs]
    texts = [make(g, rng.choice([3, 30, 300])) for g in truth]
    extra = [None, "", "123 !!", "²³ 42", make("bb", 50000)]
    docs = docs_frame(spark, texts + extra, langs=langs + [None] * 4 + ["aa"])
    model = langid.train(docs.filter("doc_id < 200"))
    assert model.langs == ["aa", "bb", "cc"] and model.code.shape == (3, 3)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == truth[i] and 0 <= got[i]["score"] <= 1 for i in range(200))
    assert [got[i]["lang_pred"] for i in range(200, 205)] == ["und"] * 4 + ["bb"]
    empty = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    one = langid.train(docs.filter("lang = 'aa'"))
    assert langid.decode(one, "abc")[0] == "aa"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_codes():
    for k in (2, 4, 7, 12, 40):
        m = langid.code_matrix(k)
        assert len({tuple(r) for r in m}) == k and (np.abs(m.sum(0)) < k).all()


# ---- 3 embeddings -------------------------------------------------------------------------------

def brute_links(vecs, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    links = [set() for _ in vecs]
    for i, j in combinations(range(len(vecs)), 2):
        if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
            a, b = np.array(vecs[i], float), np.array(vecs[j], float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def reach(links):
    out = list(range(len(links)))
    for i in range(len(links)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = min(seen)
    return out


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vecs = [list(map(float, np.float32(base[k % 40] + s * rng.normal(size=16)))) for k in range(160) for s in (0.05,)]
    vecs += [vecs[0]] * 5 + [[3 * x for x in vecs[1]]] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15,
                                                         [float("inf")] * 16, [1.0, 2.0], [2.0, 4.1]]
    chain = np.eye(16)[0]
    for k in range(12):
        chain = chain + 0.2 * np.eye(16)[(k + 1) % 16]
        vecs.append(list(map(float, chain)))
    df = clash(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)],
                                     "vec_id long, embedding array<double>, label int"))
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    links = brute_links(vecs)
    assert {i: got[i]["n_links"] for i in got} == {i: len(x) for i, x in enumerate(links)}
    assert [got[i]["component_id"] for i in range(len(vecs))] == reach(links)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = np.random.default_rng(4)
    vecs = [list(map(float, np.ones(8) + 0.1 * rng.normal(size=8))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: len(x) for i, x in enumerate(brute_links(vecs))}


def test_embedding_single_precision(spark):
    """Float vectors of extreme size give the links of the same values in double precision."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    size = [1e37, 1.0, 1e-37, 1e-44]
    vecs = [list(map(float, np.float32(size[k % 4] * (base[k % 30] + 0.1 * rng.normal(size=8))))) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>")
    links = brute_links(vecs)
    for own in (df, df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(own).collect()}
        assert got == {i: (len(links[i]), c) for i, c in enumerate(reach(links))}


def test_embedding_passes_grow():
    few, many = neardup.needed_passes(10**4, 0.95), neardup.needed_passes(10**9, 0.95)
    assert few == neardup.PASSES < 40 < many < 100
    assert neardup.needed_passes(0, 0.95) == neardup.needed_passes(10**9, 1.0) == neardup.PASSES


def test_embedding_links_in_a_cone(spark):
    """Lone pairs in a cone that a third of the vectors share are found like in brute force."""
    rng = np.random.default_rng(31)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, dim, pairs = 9000, 64, 200
    free = unit(rng.normal(size=(n * 2 // 3, dim)))
    cone = unit(np.sqrt(0.85) * unit(rng.normal(size=dim)) + np.sqrt(0.15) * unit(rng.normal(size=(n // 3, dim))))
    base = cone[:pairs]
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([cone, free, 0.955 * base + np.sqrt(1 - 0.955 ** 2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in neardup.near_duplicates(df).filter("n_links > 0").collect()}
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    assert len(near) >= pairs
    assert np.mean([got.get(int(a), -1) == got.get(int(b), -2) for a, b in near]) >= 0.97


# ---- 4 sharding ---------------------------------------------------------------------------------

def test_shards(spark, odd_texts):
    texts = odd_texts + [f"text {i} " * (i % 50) for i in range(500)]
    rows = sharding.shard_by_bytes(docs_frame(spark, texts, ids=[None, *range(len(texts) - 1)]), 16).collect()
    size = [len((t or "").encode()) + 1 for t in texts]
    want = Counter(zip([None, *range(len(texts) - 1)], size, [zlib.crc32((t or "").encode()) for t in texts]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    total, biggest = sum(size), max(size)
    for s in range(16):
        assert abs(sum(r["size"] for r in rows if r["shard"] == s) - total / 16) <= biggest
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == [None, *range(len(texts) - 1)]
    assert sharding.shard_by_bytes(docs_frame(spark, texts).limit(0)).count() == 0


# ---- 5 SimHash ----------------------------------------------------------------------------------

def brute_print(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)  # so that listings span tiles
    rng = random.Random(5)
    long = words(rng, 300).split()
    near = [" ".join(long[:k] + ["CHANGED"] + long[k:]) for k in range(0, 300, 3)]
    texts = [t for t in odd_texts if t is None or len(t) < 50000] + near + [words(rng, 40) for _ in range(100)]
    texts += ["É A b", "é a b", "Only two"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_frame(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got.values())
    links = [{j for j, q in enumerate(prints) if j != i and bin(p ^ q).count("1") <= 3} for i, p in enumerate(prints)]
    assert [got[i]["component_id"] for i in range(len(texts))] == reach(links)
    assert simhash.near_duplicates(docs_frame(spark, texts).limit(0)).count() == 0


# ---- 6 chat -------------------------------------------------------------------------------------

def test_chat_read_back(spark):
    rng = random.Random(6)
    odd = ["\\", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|>\n<|im_start|>user\n", "", None, "\n\n", "\\<|\\", "é<\\n|"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "us\ner", "<|im_end|>", None]) if t else "system",
             rng.choice(odd) if rng.random() < 0.4 else words(rng, rng.choice([1, 20, 90, 600])))
            for c in [*range(12), None] for t in range(rng.randrange(1, 30))]
    rows += [(20, 0, "assistant", "tie"), (20, 0, "assistant", "tie"), (20, None, "user", "null turn")]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    windows = chat.format_windows(df)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), digest(loss))
    for w in windows.collect():
        assert w["tokens"] <= chat.BUDGET or w["fresh_turns"] == 1 or w["formatted"].startswith("<|im_start|>system")
        parts = w["formatted"].split("<|im_end|>\n")
        assert parts[-1] == "" and len(parts) - 1 == w["context_turns"] + w["fresh_turns"]
        assert w["context_turns"] <= chat.HISTORY_TURNS + 1
        for s in w["loss_spans"]:
            assert w["formatted"][:s["start"]].endswith("<|im_start|>assistant\n")
            assert w["formatted"][s["start"] + s["length"]:].startswith("<|im_end|>\n")
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_chat_query_holds_special_conversation(spark):
    row = op6(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    assert row["n_turns"] == 2 and row["loss_sha256"] == hashlib.sha256(SPECIAL.encode()).hexdigest()


# ---- 7 HTML -------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First<br><p>Second   para\n with <i>in</i>line &lt;b&gt; &eacute;</p>
<aside>Side</aside><form><input><button>Go</button></form><p>1 < 2</p><ul><li>one<li>two</ul>
<section class="comments"><p>nice</p></section></article><div class="sidebar"><p>Links</p></div><footer>&copy; x</footer>"""


def test_blocks():
    kept = [t for k, t in html.blocks(PAGE) if k == html.MAIN]
    assert kept == ["Head & line", "First", "Second para with inline <b> é", "1 < 2", "one", "two"]
    assert html.blocks(None) == [] == html.blocks("") == html.blocks("<script>x")
    assert html.blocks("plain <b>text") == [(html.OPEN, "plain text")]
    assert html.blocks("<p hidden>a</p><p style='display:none'>b</p><!-- c") == []


def test_repeated_runs():
    rng = random.Random(8)
    for _ in range(40):
        stream, page = [], []
        for p in range(4):
            for _ in range(3):
                own = [rng.randrange(3) for _ in range(rng.randrange(0, 15))]
                stream += own + [-len(stream) - 1]
                page += [p] * (len(own) + 1)
        got = html.repeated(np.array(stream), np.array(page), 4, 2)
        want = np.zeros(len(stream), bool)
        seen = {}
        for i in range(len(stream) - 3):
            if min(stream[i:i + 4]) >= 0:
                seen.setdefault(tuple(stream[i:i + 4]), []).append(i)
        for places in seen.values():
            if len({page[i] for i in places}) >= 2:
                for i in places:
                    want[i:i + 4] = True
        assert (got == want).all()


def test_extract(spark):
    rng = random.Random(9)
    line = words(rng, 12)  # neutral markup, on every page of the host
    pages = [(i, "http://h.example/%d" % i, f"<html><body><div>{line}</div><p>{words(rng, 30)}</p><footer>{line}</footer>")
             for i in range(30)]
    pages += [(100, None, None), (101, "odd", ""), (102, "http://h.example/x", PAGE), (103, "http://h.example/x", PAGE),
              (104, "http://other.example/", f"<div>{line}</div><p>{words(rng, 20000)}</p>")]
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages[:30]:
        assert got[i] == re.search("<p>(.*?)</p>", h)[1]
    assert got[100] == got[101] == "" and got[102] == got[103] and got[102].startswith("Head & line\n")
    assert got[104].startswith(line)  # alone on its host
    small = {r["page_id"]: r["text"] for r in html.extract(df, broadcast_hosts=0).collect()}
    assert small == got
    assert html.extract(df.limit(0)).count() == 0


# ---- 8 decontamination --------------------------------------------------------------------------

def brute_contamination(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        d, hit, found = cut(t), set(), set()
        for item, text in items:
            w = cut(text)
            n = min(13, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                for j in range(len(d) - n + 1):
                    if d[j:j + n] == w[i:i + n]:
                        hit |= set(range(j, j + n))
                        found.add("" if item is None else str(item))
        out.append((len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(d)))
    return out


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination(spark, odd_texts, limit):
    rng = random.Random(10)
    items = [(i, words(rng, rng.choice([14, 30, 60]), 30)) for i in range(8)]
    items += [(20, "one"), (21, "Two words"), (22, "the É same-TEXT here"), (23, None), (24, "!!"), (None, "a, b. c! d"),
              (3, items[2][1]), (40, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    texts = [t for t in odd_texts if t is None or len(t) < 40000]
    for i in range(30):
        own = items[i % 8][1].split()
        at = rng.randrange(len(own) - 12)
        texts.append(" ".join([words(rng, rng.randrange(20), 30), *own[at:at + rng.choice([12, 13, 40])], words(rng, 300)]))
    texts += [" ".join(["w1"] * 40), items[0][1].upper().replace(" ", " -- "), items[1][1] + " " + items[1][1],
              words(rng, 2000, 12)]
    bench = clash(spark.createDataFrame(items, "item_id long, text string"))
    docs = docs_frame(spark, texts, ids=[None, *range(len(texts) - 2), 0])
    got = decontam.contamination(docs, bench, broadcast_rows=limit).collect()
    key = lambda i, x: (-1 if i is None else i, *x)
    want = [key(i, x) for i, x in zip([None, *range(len(texts) - 2), 0], brute_contamination(texts, items))]
    assert sorted(key(r[0], (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in got
                  ) == sorted(want)
    if limit:
        assert decontam.contamination(docs.limit(0), bench).count() == 0
        none = decontam.contamination(docs, bench.limit(0)).collect()
        assert len(none) == len(texts) and not any(r["n_hit"] for r in none)


def test_contamination_of_long_documents(spark):
    rng = random.Random(12)
    items = [(i, words(rng, n, 9)) for i, n in enumerate((40, 600, 13, 7, 2))] + [(5, "same same " * 20), (6, "same same " * 20)]
    texts = [" ".join(items[0][1] + f" x{i % 7}" for i in range(60)),  # the same item over and over
             " ".join([words(rng, 250, 9), items[1][1], "end", items[2][1], items[1][1][:700]]),  # across block borders
             "same " * 700, items[1][1], words(rng, 900, 9), words(rng, 900, 9) + " " + items[2][1]]
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    got = decontam.contamination(docs_frame(spark, texts), bench).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got
            ] == brute_contamination(texts, items)


def test_extract_runs_cross_blocks(spark):
    """A menu of one-word items goes by the host's pages alone; a line that the host puts into its articles is theirs."""
    rng = random.Random(19)
    menu = "".join(f"<li>{w}</li>" for w in words(rng, 9).split())
    line = words(rng, 14)
    own = [[words(rng, 40), words(rng, 25)] for _ in range(12)]
    pages = [(i, "http://m.example/%d" % i, f"<ul>{menu}</ul><p>{a}</p>") for i, (a, _) in enumerate(own)]
    pages += [(100 + i, "http://a.example/%d" % i, f"<article><p>{a}</p><p>{line}</p><p>{b}</p></article>")
              for i, (a, b) in enumerate(own)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {i: a for i, (a, _) in enumerate(own)} | {100 + i: f"{a}\n{line}\n{b}" for i, (a, b) in enumerate(own)}


def test_extract_does_not_depend_on_chunks(spark):
    """Passages on a few pages of a host are found whichever chunks these fall into."""
    rng = random.Random(21)
    rare = [words(rng, 12) for _ in range(20)]
    pages = []
    for i in range(120):
        shared = f"<div>{rare[i // 2 % 20]}</div>" if i < 80 else ""
        pages.append((i, f"http://h{i % 2}.example/{i}", f"<p>{words(rng, 30)}</p>{shared}<article>{words(rng, 9)}</article>"))
    df = spark.createDataFrame(pages + [(200, None, None)], "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert not any(x in text for x in rare for text in whole.values()) and len(whole) == 121
    for n in (1, 7):
        assert {r["page_id"]: r["text"] for r in html.extract(df, chunk_pages=n).collect()} == whole


def test_extract_class_words_are_hints(spark):
    """Wrappers and headings with a furniture word in their class keep the article; repeated blocks in them go."""
    rng = random.Random(23)
    line = words(rng, 10)
    pages, want = [], {}
    for i in range(6):
        a, b, c, d, e = (words(rng, 15) for _ in range(5))
        pages += [
            (10 * i, f'<div class="layout with-sidebar"><article><header class="entry-header"><h1>{a}</h1></header>'
                     f'<div class="article-header">{b}</div><p class="notice">{c}</p><p class="notice">{line}</p></article>'
                     f'<div class="sidebar">{d}</div></div>'),
            (10 * i + 1, f'<div id="page" class="header-fixed"><main><p>{e}</p></main></div>'),
            (10 * i + 2, f'<div class="with-sidebar"><p>{a + b}</p><p>{line}</p></div>')]
        want |= {10 * i: f"{a}\n{b}\n{c}", 10 * i + 1: e, 10 * i + 2: a + b}
    df = spark.createDataFrame([(i, f"http://h{i % 10}.example/{i}", h) for i, h in pages],
                               "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == want


# ---- 9 URLs -------------------------------------------------------------------------------------

def test_url_lists(spark):
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = [("spam", "bad.example", "block", day(10)), ("spam", "bad.example", "drop", day(20)),
               ("spam", "bad.example", "block", day(30)), ("spam", "bad.example", "block", day(30)),
               ("ok", "bad.example/news", "allow", day(12)), ("spam", "a.b.example", "block", day(5)),
               ("spam", None, "block", day(5)), ("spam", "a.b.example", "allow", None),
               ("tie", "tie.example", "block", day(1)), ("tie", "tie.example", "allow", day(1)),
               ("other", "tie.example", "allow", day(1))]
    captures = [(1, "http://www.bad.example/x", day(9)), (2, "https://u@Bad.example:80/x?q", day(10)),
                (3, "http://sub.bad.example", day(19)), (4, "http://bad.example/", day(20)), (5, "http://bad.example/", day(40)),
                (6, "http://bad.example/news/1", day(15)), (7, "http://bad.example/news", day(25)), (8, "http://b.example/", day(9)),
                (9, "http://a.b.example/", day(9)), (10, None, day(9)), (11, "no url", day(9)), (12, "http://bad.example/", None),
                (13, "http://tie.example/", day(2)), (1, "http://www.bad.example/x", day(9))]
    c = clash(spark.createDataFrame(captures, "capture_id long, url string, fetched timestamp_ntz"))
    e = spark.createDataFrame(entries, "list_name string, key string, action string, since timestamp_ntz")
    rows = urls.evaluate(c, e).collect()
    got = {r["capture_id"]: (r["verdict"], r["n_active"], r["rule_key"]) for r in rows}
    assert len(rows) == len(captures)
    assert got == {1: ("pass", 0, None), 2: ("block", 1, "bad.example"), 3: ("block", 1, "bad.example"),
                   4: ("pass", 0, None), 5: ("block", 1, "bad.example"), 6: ("allow", 2, "bad.example/news"),
                   7: ("allow", 1, "bad.example/news"), 8: ("pass", 0, None), 9: ("block", 1, "a.b.example"),
                   10: ("pass", 0, None), 11: ("pass", 0, None), 12: ("pass", 0, None), 13: ("allow", 2, "tie.example")}
    assert urls.evaluate(c.limit(0), e).count() == 0
    assert {r["verdict"] for r in urls.evaluate(c, e.limit(0)).collect()} == {"pass"}


def test_url_lists_of_deep_paths_and_odd_keys(spark):
    import datetime as dt
    since = dt.datetime(2024, 1, 1)
    keys = ["deep.example/a/b/c", "https://www.Page.example/x/y/z/?q=1#top", "WWW.host.example", "zip", "p.example/a//b/c/d/"]
    urls_of = ["http://deep.example/a/b/c/d.html", "http://deep.example/a/b/x", "http://page.example/x/y/z?q=1",
               "http://page.example/x/y/z?q=2", "http://www.host.example/1", "http://a.zip/", "http://www.p.example/a/b/c/d"]
    e = spark.createDataFrame([("l", k, "block", since) for k in keys],
                              "list_name string, key string, action string, since timestamp_ntz")
    c = spark.createDataFrame([(i, u, since + dt.timedelta(days=1)) for i, u in enumerate(urls_of)],
                              "capture_id long, url string, fetched timestamp_ntz")
    got = {r["capture_id"]: r["rule_key"] for r in urls.evaluate(c, e).collect()}
    assert got == {0: "deep.example/a/b/c", 1: None, 2: "page.example/x/y/z?q=1", 3: None, 4: "host.example", 5: "zip",
                   6: "p.example/a/b/c/d"}


# ---- 10 quality ---------------------------------------------------------------------------------

def test_quality(spark):
    rng = random.Random(12)
    clean = [words(rng, rng.choice([5, 80, 400]), 5000) for _ in range(150)]
    junk = [" ".join([words(rng, 40).upper() + "!!", words(rng, rng.choice([1, 60]), 5000)]) for _ in range(150)]
    texts = clean + junk + [None, "", words(rng, 60000)]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (2, None, 0), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    labels = clash(labels)
    model = quality.train(docs, labels, per_class=100)
    rows = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    right = [rows[i]["predicted"] == int(i < 150) for i in range(300)]
    assert np.mean(right) > 0.97 and len(rows) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert rows[300]["score"] == rows[301]["score"] and rows[302]["predicted"] == 1
    none = quality.train(docs, labels.limit(0))
    assert abs(quality.score_text(none, "x") - 0.5) < 0.2
    assert quality.score_text(quality.train(docs, labels.filter("quality = 1")), "x") > 0.9
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_gradient():
    rng = np.random.default_rng(0)
    p = {"W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)),
         "a": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(0.1)}
    x, starts, bag = rng.normal(size=(6, 5)), np.array([0, 2]), np.array([0, 0, 1, 1, 1, 1])
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss(p):
        z = quality._forward(p, x, starts, bag)[-1]
        return ((np.logaddexp(0, z) - y * z) * w).sum() / w.sum()
    g = quality._gradient(p, x, starts, bag, y, w)
    for k in p:
        for i in np.ndindex(p[k].shape):
            hi, lo = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
            hi[k][i] += 1e-5
            lo[k][i] -= 1e-5
            assert abs((loss(hi) - loss(lo)) / 2e-5 - g[k][i]) < 1e-6


def test_extract_keeps_every_article_block_of_the_given_pages(spark):
    """Whatever a host repeats: all text of plain blocks in article elements is in the result, in order."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract(pages, chunk_pages=16).collect()}
    for r in pages.collect():
        rest = iter(got[r["page_id"]])
        for kind, text in html.blocks(r["html"]):
            if kind == html.MAIN:
                assert text in rest, (r["page_id"], text)


def test_extract_does_not_depend_on_chunks_with_hints_and_copies(spark):
    """Open blocks, hints, copied articles and shared menus: one chunk, or a chunk for every few pages."""
    rng = random.Random(31)
    menu, notice = words(rng, 9), words(rng, 12)
    pages = []
    for i in range(60):
        a, b = words(rng, 30, 10**6), words(rng, 30, 10**6)
        if i % 3 == 0:
            body = f"<article><p>{a}</p><p class='notice'>{notice}</p><p class='notice'>{b}</p></article><p>{menu}</p>"
        else:
            body = f"<div>{menu}</div><p>{a}</p><div class='promo'>{notice} {b if i % 2 else ''}</div>"
        pages += [(2 * i, "http://c.example/x", body)] * (1 + (i % 4 == 0))
    pages = [(i, u, h) for i, (_, u, h) in enumerate(pages)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    one = {r["page_id"]: r["text"] for r in html.extract(df, chunk_pages=1000).collect()}
    assert one == {r["page_id"]: r["text"] for r in html.extract(df, chunk_pages=5).collect()} and len(set(one.values())) > 50


def test_quality_sample_is_bounded_in_rows_and_passages(spark):
    """Repeated labels and documents of one id take no more places; long training texts are thinned out."""
    rng = random.Random(41)
    rows = [(i, words(rng, 80, 50) if i % 2 else words(rng, 80, 10**6)) for i in range(40)]
    docs = docs_frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    one = quality.train(docs, labels, per_class=10)
    more = quality.train(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels), per_class=10)
    assert all(np.array_equal(one.p[k], more.p[k]) for k in one.p) and one.shift == more.shift
    long = docs_frame(spark, [words(rng, 20000), *[t for _, t in rows]], ids=[100, *[i for i, _ in rows]])
    marked = labels.unionByName(spark.createDataFrame([(100, 1)], labels.schema))
    thin = quality.train(long, marked, max_passages=2)
    assert np.isfinite(quality.score_text(thin, words(rng, 20000)))
