"""Piece encoding by a score-ordered agenda, and decoding, with a `sentencepiece` model of merge type.

A text starts as single characters. An agenda holds the adjacent pairs that
are a piece of the vocabulary, best score first and leftmost first among
equals; the best pair that still stands is merged and its new neighbours are
put on the agenda, until it is empty. Texts are cut beforehand only where no
piece of the vocabulary could ever join the two sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # how the vocabulary writes a space
# Kinds of pieces and the kind of model in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2

POSITIONS = (6, 40)  # bits of a position in an agenda entry: for short texts, so that entries stay small numbers, and for all
SLICE = 4 << 20  # bytes of text that are cut into segments at a time

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of a text by the agenda; segments that were met before are kept."""

    KEEP = 400_000  # segments in each of the two generations kept per worker
    SHORT = 64      # characters of a segment that is kept

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        if model.trainer_spec.model_type != MERGES:
            raise ValueError(f"{path}: not a vocabulary of merges")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError(f"{path}: pieces defined by the user are not known here")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        of_byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes = [of_byte[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.learn({p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)},
                   {p.piece for p in model.pieces if p.type == UNUSED})

    def learn(self, pieces: dict[str, tuple[int, float]], unused: set[str]) -> None:
        """Take a vocabulary (piece: id and score); pieces of equal scores share their place on the agenda."""
        by_score = sorted({score for _, score in pieces.values()}, reverse=True)
        rank = {score: i for i, score in enumerate(by_score)}
        self.place = {bits: {p: rank[score] << bits for p, (_, score) in pieces.items()} for bits in POSITIONS}
        self.unused, self.coded = unused, {p: np.uint32(i).tobytes() for p, (i, _) in pieces.items()}
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Kinds of characters: in no longer piece, letter, other, space. A text is cut between two
        # neighbours if no piece holds a pair of their kinds, so no merge is lost.
        longer = [p for p in pieces if len(p) > 1]
        self.kind = np.zeros(0x110000, np.uint8)
        for c in {c for p in longer for c in p}:
            self.kind[ord(c)] = 3 if c == SPACE else 1 if c.isalpha() else 2
        self.cut = np.ones((4, 4), bool)
        for p in longer:
            k = self.kind[[ord(c) for c in p]]
            self.cut[k[:-1], k[1:]] = False

    def segments(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """(segments of all texts, the first segment of each text and their number)."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        kind = self.kind[chars]
        start = np.ones(len(chars), bool)
        start[1:] = self.cut[kind[:-1], kind[1:]]
        ends = np.cumsum([0, *map(len, texts)])
        start[ends[ends < len(chars)]] = True
        first = np.append(0, np.cumsum(start))[ends]
        width = 1 + (chars > 0x7F).astype(np.int8) + (chars > 0x7FF) + (chars > 0xFFFF)
        at = np.append(np.append(0, np.cumsum(width, dtype=np.int32))[:-1][start], width.sum(dtype=np.int32))
        data = pa.py_buffer("".join(texts).encode())
        return pa.StringArray.from_buffers(int(start.sum()), pa.py_buffer(at.astype(np.int32)), data), first

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by the agenda of adjacent pairs.

        An entry is the place of the pair's score among all scores and the
        position of its left side, in one number, so the smallest entry is the
        best and leftmost pair; ``now`` holds the entry that stands at a position.
        """
        sym, n = list(text), len(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        bits = POSITIONS[n > 1 << POSITIONS[0]]
        place, position = self.place[bits].get, (1 << bits) - 1
        now: list[int] = [-1] * n
        agenda = []
        for i in range(n - 1):
            at = place(text[i:i + 2])
            if at is not None:
                now[i] = at = at + i
                agenda.append(at)
        heapify(agenda)
        made_of: dict[str, tuple[str, str]] = {}
        while agenda:
            entry = heappop(agenda)
            a = entry & position
            if now[a] != entry:
                continue  # a side was merged with another neighbour since
            b = right[a]
            pair = sym[a] + sym[b]
            if pair in self.unused:
                made_of[pair] = (sym[a], sym[b])
            sym[a], sym[b] = pair, ""
            right[a] = after = right[b]
            now[a] = now[b] = -1
            if after < n:
                left[after] = a
                at = place(pair + sym[after])
                if at is not None:
                    now[a] = at = at + a
                    heappush(agenda, at)
            before = left[a]
            if before >= 0:
                at = place(sym[before] + pair)
                if at is None:
                    now[before] = -1
                else:
                    now[before] = at = at + before
                    heappush(agenda, at)
        out = [s for s in sym if s]
        if not made_of:
            return out
        rest, out = out[::-1], []
        while rest:  # pieces marked as unused fall back to the two they were merged from
            s = rest.pop()
            if s in made_of:
                rest += made_of[s][::-1]
            else:
                out.append(s)
        return out

    def _segment(self, s: str) -> bytes:
        """Ids of a segment: kept ones of two generations, or by the agenda."""
        out = self.seen.get(s) or self.older.get(s)
        if out is None:
            known = self.coded.get
            out = b"".join([known(p) or self._unknown(p) for p in self.merge(s)])
        if len(s) <= self.SHORT:
            if len(self.seen) >= self.KEEP:
                self.older, self.seen = self.seen, {}
            self.seen[s] = out
        return out

    def _unknown(self, piece: str) -> bytes:
        return np.array([self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown], "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, normalised as the model says; each different segment is looked up once."""
        parts, first = self.segments([self.library.normalize(t) for t in texts])
        if not len(parts):
            return [np.zeros(0, "<u4") for _ in texts]
        parts = parts.dictionary_encode()
        latest, look = self.seen.get, self._segment
        own = [latest(s) or look(s) for s in parts.dictionary.to_pylist()]
        ends = np.cumsum([0, *map(len, own)]) >> 2
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(own), "<u4")))
        got = lists.take(parts.indices)
        at = got.offsets.to_numpy()[first]
        out = [got.values.to_numpy()[s:e] for s, e in zip(at, at[1:])]
        if not self.bytes:  # neighbouring unknown pieces are one
            out = [x[~((x == self.unknown) & np.append(False, x[:-1] == self.unknown)[:len(x)])] for x in out]
        return out

    def library_ids(self, text: str) -> np.ndarray:
        return self.library.encode_as_numpy(text, add_bos=False, add_eos=False).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


def encoder(path: str) -> Encoder:
    """The encoder of a model file, loaded once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded, agrees): every text's ids by the agenda, and the text that decode(ids) gives back.

    ``agrees`` says whether the library encodes the whole text to the same
    ids; it is compared text by text in each Arrow batch. Null text is empty
    and has no ids; rows are handled one by one, so repeated rows and ids give
    one row each; an empty table gives none; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(model_path)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # a slice of bounded bytes at a time, one text at least
                to = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE)), at + 1)
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                ids = enc.ids(texts)
                agrees = [np.array_equal(own, enc.library_ids(t)) for own, t in zip(ids, texts)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array([enc.decode(own) for own in ids], pa.string()), pa.array(agrees, pa.bool_())],
                    ["id", "ids", "decoded", "agrees"])
                at = to
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, ids array<int>, decoded string, agrees boolean")
