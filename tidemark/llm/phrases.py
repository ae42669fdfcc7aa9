"""Phrase collocation mining in shards, level by level (Agrawal and Srikant, 1994; Savasere, Omiecinski and Navathe, 1995).

A shard is a run of whole documents that fits a task. A first pass counts the
words and pairs of every shard, a second one the longer phrases, looked at
only where each pair in them is frequent in the whole table. The frequent
pairs travel as a bit set of fixed size (no member is missed, a stray hit is
only counted for nothing). No support is shared out over the shards: what a
shard sends is bounded by its words, whatever the table's size. It goes in
blocks, dealt by a hash of the phrase, that are added up exactly, by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import by_parts, cut, key_runs, partitions

SHARD_WORDS = 1_500_000    # words of one shard, half as many to 1.5 times as many: bounds a task's memory
SHARDS = 32                # shards at least: small tables have small shards
TASK_SHARDS = 4            # shards of a task, on large tables
BLOCK_WORDS = 4_000_000    # words of the table whose phrases are added up together: bounds a task's memory
BITS = 26                  # the set of phrases has 2^26 bits: 8 MB, whatever the table's size
CHUNK = 16                 # and travels to the driver in rows of 2^16 bits

# Bytes that end a piece, and bytes that end a word only (fixed by the operator's contract).
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_END = b"\x20\x09"
WORD = r"[^ \t.,;:!?\n-\r]+"

_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_END)] = 1
_KIND[list(PIECE_END)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a phrase from that of all but its last word and that of the last word."""
    x = prefix * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hash(values: list) -> np.ndarray:
    import xxhash
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values], np.uint64)


def _places(h: np.ndarray) -> np.ndarray:
    """The two bits of each hash."""
    low = np.uint64((1 << BITS) - 1)
    return np.concatenate([h & low, (h >> np.uint64(32)) & low]).astype(np.int64)


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for s in range(0, len(h), 1 << 16):  # a slice at a time: the bits of a phrase are spread over 8 MB
        own = h[s:s + (1 << 16)]
        at = _places(own)
        got = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        hit[s:s + len(own)] = got[:len(own)] & got[len(own):]
    return hit


class _Shard:
    """Words of whole documents as numbers, with the piece of each and the language of each piece."""

    SLICE = 1 << 20  # bytes of text that are split at a time
    TURN = 1 << 19   # occurrences whose phrases are numbered at a time

    def __init__(self):
        self.words: list[pa.DictionaryArray] = []
        self.pieces: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.names: dict[str, int] = {}
        self.n, self.piece = 0, 0

    def add(self, langs: pa.Array, texts: pa.Array) -> None:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(int(np.searchsorted(sizes, done + self.SLICE)), at + 1)
            self._split(langs.slice(at, to - at), pc.fill_null(texts.slice(at, to - at), ""))
            at = to

    def _split(self, langs: pa.Array, texts: pa.Array) -> None:
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        if off[-1] == off[0]:
            return
        data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0]:off[-1]]
        off = (off - off[0]).astype(np.int64)
        kind = _KIND[data]
        inside = np.concatenate([[False], kind == 0, [False]])
        start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        firsts = off[:-1][off[:-1] < len(data)]  # a document's first byte starts a word, the byte before it ends one
        start[firsts] |= inside[1:-1][firsts]
        lasts = off[1:][off[1:] > 0] - 1
        end[lasts] |= inside[1:-1][lasts]
        begin = np.flatnonzero(start)
        if not len(begin):
            return
        ends = np.append(0, np.cumsum(np.flatnonzero(end) + 1 - begin)).astype(np.int32)
        letters = _LOWER[data[inside[1:-1]]]
        words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        doc = np.searchsorted(off, begin, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), begin) + doc
        first = np.append(True, piece[1:] != piece[:-1])
        piece = self.piece - 1 + np.cumsum(first)  # pieces without words have no number
        self.piece = int(piece[-1]) + 1
        numbers = [self.names.setdefault("und" if g is None else g, len(self.names)) for g in langs.to_pylist()]
        self.words.append(words.dictionary_encode())
        self.pieces.append(piece.astype(np.int32))
        self.langs.append(np.array(numbers, np.int32)[doc[first]])
        self.n += len(begin)

    def join(self, other: _Shard) -> None:
        """Take the words of ``other`` too."""
        number = np.array([self.names.setdefault(g, len(self.names)) for g in other.names], np.int32)
        self.words += other.words
        self.pieces += [p + np.int32(self.piece) for p in other.pieces]
        self.langs += [number[g] for g in other.langs]
        self.n, self.piece = self.n + other.n, self.piece + other.piece

    def levels(self, max_words: int, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray]):
        """(words, languages, phrases, counts, hashes) for the phrases of 1, 2, ... words that ``keep`` takes.

        A longer phrase is looked at only where both phrases of one word less
        are kept, and phrases are numbered exactly (number of the phrase before
        the last word, last word), so a shard's counts do not rest on hashes.
        """
        if not self.n:
            return
        words = pa.chunked_array(self.words).unify_dictionaries()
        vocab = words.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy() for c in words.chunks])
        piece, lang_of = np.concatenate(self.pieces), np.concatenate(self.langs)
        self.words, self.pieces, self.langs, words = [], [], [], None  # a shard is mined once
        size = np.int64(len(vocab))
        word_hash, names = _hash(vocab.to_pylist()), list(self.names)
        before_hash, before_lang = _hash([g.encode() for g in names]), np.arange(len(names), dtype=np.int32)
        before_text = None
        at, key = np.arange(len(code), dtype=np.int32), (lang_of * size)[piece] + code
        for k in range(1, max_words + 1):
            # the keys in turns, dealt by their value: only phrases that are kept outlive their turn
            turns = 1 + len(key) // self.TURN
            ids, first, kept = np.full(len(key), -1, np.int32), 0, []
            deal = np.empty(len(key), np.uint16)
            for s in range(0, len(key), self.TURN):
                deal[s:s + self.TURN] = key[s:s + self.TURN] % turns
            for turn in range(turns):
                own = np.flatnonzero(deal == turn) if turns > 1 else slice(None)
                got = pa.array(key[own]).dictionary_encode()
                uniq, row = got.dictionary.to_numpy(), got.indices.to_numpy()
                counts = np.bincount(row, minlength=len(uniq))
                prefix = uniq // size
                word = (uniq - prefix * size).astype(np.int32)
                h = _mix(before_hash[prefix], word_hash[word])
                ok = keep(k, counts, h)
                ids[own] = np.where(ok, first + np.cumsum(ok) - 1, -1).astype(np.int32)[row]
                kept.append((prefix[ok].astype(np.int32), word[ok], counts[ok], h[ok]))
                first += len(kept[-1][0])
            del got, uniq, row, h, key, own, deal
            prefix, word, counts, before_hash = (np.concatenate(x) for x in zip(*kept))
            last = vocab.take(pa.array(word))
            before_text = last if k == 1 else pc.binary_join_element_wise(
                before_text.take(pa.array(prefix)), last, pa.scalar(b" "))
            before_lang = before_lang[prefix]
            yield k, pa.array(names).take(pa.array(before_lang)), before_text, counts, before_hash
            at, ids = at[ids >= 0], ids[ids >= 0]
            pair = np.flatnonzero(at[1:] == at[:-1] + 1).astype(np.int32)
            pair = pair[piece[at[pair]] == piece[at[pair] + k]]
            at = at[pair]
            if not len(at):
                return
            key = ids[pair] * size + code[at + k]


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[_Shard]:
    """Shards of about ``shard_words`` words; a short rest joins the shard before it, for its support would be low."""
    shard, ready = _Shard(), None
    for batch in batches:
        step = max(1, batch.num_rows // 8)
        for at in range(0, batch.num_rows, step):
            shard.add(batch.column(0).slice(at, step), batch.column(1).slice(at, step))
            if shard.n >= shard_words:
                if ready is not None:
                    yield ready
                    pa.default_memory_pool().release_unused()  # what mining the last one took
                shard, ready = _Shard(), shard
    if ready is not None and shard.n < shard_words // 2:
        ready.join(shard)
    else:
        if ready is not None:
            yield ready
        ready = shard
    yield ready


def _bit_set(spark, parts: DataFrame) -> np.ndarray:
    """The set of phrases with the bits ``parts(chunk, bit)``: never more than 2^BITS bits."""
    def pack(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = (batch.column(i).to_numpy() for i in (0, 1))
            for c in np.unique(chunk):
                own = held.setdefault(int(c), np.zeros(1 << CHUNK - 3, np.uint8))
                at = np.unique(bit[chunk == c])
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                          pa.array([v.tobytes() for v in held.values()], pa.binary())], ["chunk", "bits"])
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in by_parts(parts, "chunk").mapInArrow(pack, "chunk int, bits binary").collect():
        at = r["chunk"] << CHUNK - 3
        bits[at:at + (1 << CHUNK - 3)] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def _bit_rows(h: np.ndarray) -> pa.RecordBatch:
    at = np.unique(_places(h))
    return pa.RecordBatch.from_arrays([pa.array((at >> CHUNK).astype(np.int32)),
                                       pa.array((at & (1 << CHUNK) - 1).astype(np.int32))], ["chunk", "bit"])


def _blocks(lang: pa.Array, text: pa.Array, counts: np.ndarray, h: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, lang, phrases, counts): the phrases of each part of the hashes and language, a line each, compressed."""
    langs = lang.dictionary_encode()
    part = (h >> np.uint64(20)) % np.uint64(parts)
    key = part.astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order].astype("<i8")
    starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    lists = pa.LargeListArray.from_arrays(pa.array(starts), text.cast(pa.large_binary()).take(pa.array(order)))
    lines = pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary()))
    own = key[starts[:-1]]
    return pa.RecordBatch.from_arrays(
        [pa.array((own // len(langs.dictionary)).astype(np.int32)),
         langs.dictionary.take(pa.array(own % len(langs.dictionary))),
         pa.array([zlib.compress(v.as_py(), 1) for v in lines], pa.binary()),
         pa.array([zlib.compress(counts[s:e].tobytes(), 1) for s, e in zip(starts[:-1], starts[1:])], pa.binary())],
        ["part", "lang", "phrases", "counts"])


def _add_up(table: pa.Table, lang: str, min_count: int) -> pa.RecordBatch:
    """(lang, phrase, m, a) of the phrases with ``min_count`` occurrences in the blocks of one part and language."""
    data = np.frombuffer(b"".join(zlib.decompress(v) + b"\n" for v in table.column("phrases").to_pylist()), np.uint8)
    ends = np.append(0, np.flatnonzero(data == 10) + 1).astype(np.int64)
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    counts = np.concatenate([np.frombuffer(zlib.decompress(v), "<i8") for v in table.column("counts").to_pylist()])
    sums = (pa.TableGroupBy(pa.table({"phrase": lines, "a": counts}), "phrase", use_threads=False)
            .aggregate([("a", "sum")]))
    often = sums.filter(pc.greater_equal(sums["a_sum"], min_count)).combine_chunks()
    phrase = pc.utf8_rtrim(often["phrase"].combine_chunks().cast(pa.large_string()), "\n").cast(pa.string())
    m = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase, m, often["a_sum"].combine_chunks()],
                                      ["lang", "phrase", "m", "a"])


def _exact(docs: DataFrame, total: int, bits: np.ndarray | None, lengths: tuple[int, int], min_count: int,
           shard_words: int) -> DataFrame:
    """(lang, phrase, m, a) of all phrases of ``lengths`` words with ``min_count`` occurrences.

    With ``bits``, phrases of three words or more are looked at only where it
    holds all their pairs. A shard's counts go in blocks by a hash of the
    phrase; there are as many parts as keep the phrases of one within what
    ``BLOCK_WORDS`` words can hold, and a phrase comes from a shard once.
    """
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    low, high = lengths
    parts = max(1, -(-total // BLOCK_WORDS))

    def count(batches):
        held = None if shared is None else np.frombuffer(shared.value, np.uint8)

        def keep(k, counts, h):
            return _holds(held, h) if k == 2 and held is not None else np.ones(len(h), bool)
        for shard in _shards(batches, shard_words):
            for k, lang, text, counts, h in shard.levels(high, keep):
                if k >= low and len(counts):
                    got = _blocks(lang, text, counts, h, parts)
                    for s in range(0, got.num_rows, 1000):
                        yield got.slice(s, 1000)

    def add_up(batches):
        for table, starts in key_runs(batches, ["part"]):
            for s, e in zip(starts[:-1], starts[1:]):
                own = table.slice(s, e - s)
                for lang in pc.unique(own["lang"]).to_pylist():
                    yield _add_up(own.filter(pc.equal(own["lang"], lang)), lang, min_count)
    blocks = docs.mapInArrow(count, "part int, lang string, phrases binary, counts binary")
    return cut(blocks.repartition(max(parts, partitions(docs)), "part").sortWithinPartitions("part")
               .mapInArrow(add_up, "lang string, phrase string, m int, a long"))


def _phrase_bits(phrases: DataFrame) -> np.ndarray:
    """The bit set of phrases that are known as text."""
    def run(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                h = _hash([lang.encode()])
                for w in _hash([w.encode() for w in phrase.split(" ")]):
                    h = _mix(h, w)
                hashes.append(h)
            if hashes:
                yield _bit_rows(np.concatenate(hashes))
    return _bit_set(phrases.sparkSession, phrases.select("lang", "phrase").mapInArrow(run, "chunk int, bit int"))


def frequent_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, text_col: str = "text",
                     lang_col: str = "lang", shard_words: int = SHARD_WORDS,
                     shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, a), (lang, n)): all phrases of 1 to ``max_words`` words met ``min_count`` times or more.

    Words are lower-cased (A-Z) and phrases stay inside pieces; n counts the
    words of a language. There are ``shards`` shards, or as many as keep a
    shard near ``shard_words`` words. Two passes: words and pairs, then the
    longer phrases where all their pairs were counted and found frequent.
    """
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    per_lang = cut(own.groupBy(F.coalesce("lang", F.lit("und")).alias("lang"))
                   .agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")), F.lit(0)).alias("n")))
    total = int(per_lang.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    shard_words = max(1, min(shard_words, -(-total // shards)))
    # two tasks a core, or more where a task would go through many shards: small files make no small shards
    own = own.coalesce(max(2 * own.sparkSession.sparkContext.defaultParallelism, total // (TASK_SHARDS * shard_words)))
    short = _exact(own, total, None, (1, min(2, max_words)), min_count, shard_words)
    if max_words < 3:
        return short, per_lang
    bits = _phrase_bits(short.filter("m = 2"))
    return short.unionByName(_exact(own, total, bits, (3, max_words), min_count, shard_words)), per_lang


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang", shard_words: int = SHARD_WORDS, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_words`` words.

    A phrase's score is that of its weakest cut, floor(1000 * a * n / (l * r))
    in exact decimals (products of up to 38 digits); ties go to the shortest
    first part. A phrase is dropped if a phrase one word longer that holds it
    is met as often, which is the same as any longer one: counts never rise
    with the length. Ranks are by score and a descending, then by the
    phrase's bytes. Null text is empty and a null language ``und``; repeated
    rows count each time; empty tables and tables without frequent phrases give
    no rows; other columns are not read.
    """
    phrases, per_lang = frequent_phrases(docs, min_count, max_words, text_col, lang_col, shard_words, shards)
    known = phrases.select("lang", "phrase", "a")
    long = phrases.filter("m > 1").withColumn("w", F.split("phrase", " "))
    cuts = (long.select("lang", "phrase", "a", "w", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
            .select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"),
                    F.expr("array_join(slice(w, k + 1, m - k), ' ')").alias("rest")))
    parts = (cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
             .join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
             .join(per_lang, "lang"))
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    scored = (parts.select("lang", "phrase", "a", "n", "k", "l", "r",
                           (wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).alias("up"),
                           (wide["l"] * wide["r"]).alias("down"))
              .withColumn("score", F.expr("cast(up div down as bigint)"))
              .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c")))
    inside = (long.filter("m > 2")
              .select("lang", "a", F.explode(F.expr("array(array_join(slice(w, 1, m - 1), ' '), "
                                                    "array_join(slice(w, 2, m - 1), ' '))")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    rows = (scored.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < c.a")
            .select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
