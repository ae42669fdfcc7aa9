"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` ids. Pieces are dealt
into groups of bounded size; each group packs by best-fit decreasing, and
dual-feasible functions give a lower bound on its bins. What a group cannot
prove full (its emptiest bins) is exchanged: the released pieces of several
groups meet in one group and are packed again, until one group is left.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_parts, cut, key_runs

GROUP_PIECES = 4096   # pieces that one group of the first round holds on average
FAN_IN = 16           # groups whose released pieces meet in the next round
GAP_SHARE = 0.95      # share of a group's free space that its released bins hold

_ENCODERS: dict[str, "_Encoder"] = {}


# The normaliser and the splitter of the tokenizer files whose words may be taken one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class _Kept(dict):
    """Ids of chunks, worked out when first asked for; frequent ones come back from those kept before."""

    KEEP = 200_000  # chunks kept per worker, and as many that were kept before them

    def __init__(self, of):
        self.of, self.old = of, {}

    def __missing__(self, c: str) -> bytes:
        out = self.old.get(c)
        if out is None:
            out = self.of(c) if c else b""
        if len(c) <= 64:
            if len(self) >= self.KEEP:
                self.old = dict(self)
                self.clear()
            self[c] = out
        return out


class _Encoder:
    """Ids of a text by a `tokenizers` file, with the ids of words kept.

    The tokenizer's own splitter never joins characters across white space, so
    a text's ids are those of its space-separated chunks in order. A chunk of
    Latin letters that are one character each is one pre-token that goes
    straight to the BPE model; closing ASCII marks are one more, and other
    printable ASCII chunks are parted as the splitter does. Any other chunk
    takes the full pipeline as it is. Files with another normaliser or
    splitter take the full pipeline for whole texts.
    """

    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # the splitter on lower-case printable ASCII

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        own = json.loads(self.tok.to_str())
        self.known = (own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == SPLITTER
                      and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in own["added_tokens"])
                      # such a token lies neither in letters nor in letters with closing marks
                      and all(re.match(r"\W.*[^\W\d_]", t["content"]) for t in own["added_tokens"]))
        self.added = [t["content"] for t in own["added_tokens"]]
        self.seen = _Kept(self._chunk)
        # the byte-level alphabet: printable bytes stand for themselves, others are moved past 255
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: b for b in own} | {
            b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(own))}

    def _full(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _plain(c: str) -> bool:
        """Letters that neither normalising nor lower-casing joins, parts or reorders."""
        return c.isalpha() and len(c) <= 100 and (c.isascii() or max(c) < "\u0250" and "\u0130" not in c)

    def _word(self, w: str) -> bytes:
        w = w.lower()
        if not w.isascii():
            w = w.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(w)]).tobytes()

    def _chunk(self, c: str) -> bytes:
        if self._plain(c):
            return self._word(c)
        letters = c.rstrip(self.MARKS)
        if len(letters) < len(c) and self._plain(letters):
            return self.seen[letters] + self.seen[c[len(letters):]]
        if c.isascii() and c.isprintable():
            words = self.WORDS.findall(c.lower())
            if len(words) == 1:
                return self._word(c)
            if not any(t in c for t in self.added):
                return b"".join(map(self.seen.__getitem__, words))
        return self._full(c)

    def ids(self, text: str) -> np.ndarray:
        if not self.known:
            return np.frombuffer(self._full(text), "<u4")
        if text.isascii():
            text = text.lower()
        return np.frombuffer(b"".join(map(self.seen.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids plus ``end_id``, cut into pieces.

    Only documents of more than ``capacity`` ids are cut; the last piece may
    be shorter. Null and empty texts give one piece holding ``end_id``. Rows
    are handled one by one, so equal rows give equal pieces. ``with_ids``
    carries the ids themselves.
    """
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]):
        enc = _encoder(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            ids_out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at:at + capacity]
                    out.append((doc, i, at, len(own), zlib.crc32(own.tobytes())))
                    if with_ids:
                        ids_out.append(own.astype(np.int64))
            cols = list(zip(*out)) if out else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, free space of each bin) by best-fit decreasing.

    Bins are listed by free space; a bit set of the spaces in use finds the
    tightest bin that still takes the item.
    """
    bins = np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fits = used >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                used &= ~(1 << space)
        else:
            space, b = capacity, opened
            opened += 1
        bins[i] = b
        by_space[space - need].append(b)
        used |= 1 << (space - need)
    free = np.empty(opened, np.int64)
    for space, own in enumerate(by_space):
        free[own] = space
    return bins, free


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins of ``lengths``: the best of two families of dual-feasible functions.

    f_e (Martello and Toth): items over capacity - e count as full, items under
    e as nothing. u_k (Fekete and Schepers): lengths rounded down to k-ths.
    Evaluated on the histogram of lengths.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    count, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * size))
    e = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = max(best, int(np.max(large + -(-middle // capacity), initial=0)))
    for k in range(1, 33):
        x = (k + 1) * size
        whole = x % capacity == 0
        # in units of 1 / (k * capacity)
        u = np.where(whole, k * size, (x // capacity) * capacity)
        best = max(best, -(-int((n * u).sum()) // (k * capacity)))
    return best


def _pack_group(lengths: np.ndarray, order: np.ndarray, capacity: int):
    """(bin, offset, released) of each piece of one group; ``order`` breaks ties."""
    ranked = np.lexsort((order, -lengths))
    bins = np.empty(len(lengths), np.int64)
    got, free = best_fit(lengths[ranked], capacity)
    bins[ranked] = got
    by_bin = np.lexsort((order, bins))
    ends = np.cumsum(lengths[by_bin])
    first = np.searchsorted(bins[by_bin], np.arange(len(free)))
    base = ends[first] - lengths[by_bin][first]
    offset = np.empty(len(lengths), np.int64)
    offset[by_bin] = ends - lengths[by_bin] - base[bins[by_bin]]
    out = np.zeros(len(free), bool)
    if free.sum() >= 1:
        emptiest = np.argsort(-free, kind="stable")
        if len(free) == bin_bound(lengths, capacity):
            # certified: no packing of these pieces has fewer bins; only its emptiest bin can help others
            out[emptiest[:1]] = free[emptiest[0]] > 0
        else:
            need = np.searchsorted(np.cumsum(free[emptiest]), GAP_SHARE * free.sum()) + 1
            out[emptiest[:need]] = free[emptiest[:need]] > 0
    return bins, offset, out[bins]


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES,
         fan_in: int = FAN_IN) -> DataFrame:
    """Add (sequence_id, offset) to ``pieces(id, piece, start, length, ids_crc32)``.

    Lengths lie between 1 and ``capacity``. Groups are dealt by a hash of
    all columns and a number of the row within its partition, which is written before it
    is used, so no key decides their size, nor rows of one id or of none; a released bin goes on whole as
    the pieces it holds. The number of rounds is the logarithm (base
    ``fan_in``) of the number of groups; each writes only the rows that are
    still open. Lengths that leave gaps everywhere release nearly all pieces:
    then groups are merged only as far as they hold ``group_pieces * fan_in``
    pieces on average, and the packing stands when they no longer get fewer,
    so no task's work grows with the table. Equal pieces are packed like any
    others; no pieces give no rows.
    """
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    own = ["id", "piece", "start", "length", "ids_crc32"]
    schema = ("id long, piece int, start long, length long, ids_crc32 long, "
              "grp long, bin long, offset long, released boolean")

    def run(batches):
        for table, starts in key_runs(batches, ["grp"]):
            length = table.column("length").to_numpy()
            # ids may be null: ties are broken by the order of the sort in the partition
            bins, offset, out = (np.empty(len(length), t) for t in (np.int64, np.int64, bool))
            for s, e in zip(starts[:-1], starts[1:]):
                bins[s:e], offset[s:e], out[s:e] = _pack_group(length[s:e], np.arange(e - s), capacity)
            done = [table.column(c) for c in [*own, "grp"]] + [pa.array(bins), pa.array(offset), pa.array(out)]
            yield from pa.Table.from_arrays(done, [*own, "grp", "bin", "offset", "released"]).to_batches()

    done = None
    todo = pieces.withColumn("grp", F.pmod(F.xxhash64(*own, "row"), F.lit(groups)))
    for level in range(64):
        packed = cut(by_parts(todo, "grp").sortWithinPartitions("grp", "id", "piece", "length", "ids_crc32")
                     .select(*own, "grp").mapInArrow(run, schema))
        released = 0 if groups == 1 else packed.filter("released").count()
        merged = max(-(-groups // fan_in), -(-released // (group_pieces * fan_in)))
        last = merged >= groups
        closed = packed if last else packed.filter("not released")
        # 6 bits of the level, 33 of the group, 24 of the bin, whose number stays below the pieces of a group
        if groups > 1 << 33:
            raise ValueError(f"pack: {groups} groups are more than a sequence_id can tell apart")
        bins = F.when(F.col("bin") < 1 << 24, F.col("bin")).otherwise(F.raise_error(F.lit("pack: a group of over 2^24 bins")))
        closed = closed.select(*own, (F.lit(level << 57) + F.shiftleft("grp", 24) + bins).alias("sequence_id"), "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        groups = merged
        todo = packed.filter("released").select(*own, F.pmod(F.xxhash64("grp"), F.lit(groups)).alias("grp"))
    raise RuntimeError("pack: groups did not shrink")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of all ``docs`` packed into sequences of at most ``capacity`` ids.

    Null text counts as empty; a document of one word is one short piece; a
    very long one fills whole sequences and leaves one shorter piece. Other
    columns of ``docs`` are not read.
    """
    packed = pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                         "sequence_id", "offset")
