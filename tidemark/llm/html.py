"""Main-text extraction with host suffix arrays.

A page becomes a row of visible blocks, each with a kind that its markup
suggests: article, furniture or open. A host's pages are dealt into chunks,
whose token streams are concatenated; a suffix array finds the runs of each
chunk, hashes of the runs are added up over the host's chunks, and a block goes
if the share of it under runs that enough pages hold reaches what its kind asks.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_parts, cut, per_key
from tidemark.llm.urls import host_of

MIN_RUN = 6          # tokens of a repeated run
MIN_PAGES = 2        # distinct pages that share it
HINT_COVERED = 0.25  # share of a block with a furniture word in a class or id
COVERED = 0.5        # share of an open block's tokens under repeated runs that makes it boilerplate
CHUNK_PAGES = 512    # pages of a host in one suffix array, on average

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_HIDDEN = _RAW | {"head", "svg", "math", "canvas", "object", "audio", "video", "map"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "fieldset", "dialog", "search"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar",
                 "dialog", "alert", "alertdialog", "toolbar"}
_MAIN = {"article", "main"}
_MAIN_ROLES = {"main", "article"}
# words of class and id values that hint at page furniture
_CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs pagination pager footer header masthead sidebar aside widget related recommended "
    "comment comments disqus reply replies reactions cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social toolbar skip".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends an open <p>; these end their own kind
_SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
# a class or id word hints at furniture, outside or inside an article
OPEN, MAIN, CHROME, HINT, MAIN_HINT = range(5)


def _furniture(tag: str, attrs: str, inside: int) -> int:
    """CHROME, MAIN, HINT or OPEN by tag and attributes, and for a header by what it is in; -1 for what is not shown."""
    if tag in _HIDDEN:
        return -1
    heading = tag == "header" and inside in (MAIN, MAIN_HINT)  # an article's own heading
    kind = CHROME if tag in _CHROME and not heading else MAIN if tag in _MAIN else OPEN
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return -1
            if name == "role":
                role = value.strip().lower()
                kind = CHROME if role in _CHROME_ROLES else MAIN if role in _MAIN_ROLES else kind
            elif name in ("class", "id") and kind == OPEN and tag not in ("html", "body"):
                if any(w.lower() in _CHROME_WORDS for w in _WORDS.findall(html.unescape(value))):
                    kind = HINT
    return kind


def _within(outer: int, own: int) -> int:
    """The kind in force inside an element of kind ``own`` that stands in ``outer``."""
    if -1 in (outer, own):
        return -1
    if CHROME in (outer, own):
        return CHROME
    if own == MAIN:  # also where a wrapper's class word hints at furniture
        return MAIN
    if own == HINT:
        return MAIN_HINT if outer in (MAIN, MAIN_HINT) else HINT
    return outer


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the page's visible blocks in order.

    Character references are decoded once, white space inside a block becomes
    one space, empty blocks are left out. A block inside a furniture element is
    CHROME even within an article; a header of an article stays with the
    article. A class or id word makes a block HINT or, in an article,
    MAIN_HINT, up to the next article or main element inside. Unclosed tags end
    with their parent; unclosed comments
    and scripts run to the end of the page.
    """
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # (tag, kind in force inside)
    kind, text, at = OPEN, [], 0

    def flush():
        nonlocal text
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((kind, line))
            text = []

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at and kind != -1:
            text.append(page[at:lt])
        if lt == len(page):
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a bare "<"
            if kind != -1:
                text.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        if m[1] is not None and kind != -1:
            text.append(html.escape(m[1]))
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag not in _INLINE or tag in _HIDDEN:
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                new = stack[-1][1] if stack else OPEN
                if new != kind:
                    flush()
                kind = new
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:  # its content is no markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _SELF_CLOSING and stack and stack[-1][0] == tag:
            stack.pop()
        new = _within(kind, _furniture(tag, m[4] or "", kind))
        if new != kind:
            flush()
            kind = new
        stack.append((tag, kind))
    flush()
    return out


def places(stream: np.ndarray, page: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, pages): the run of ``min_run`` tokens that starts at each place, and the distinct pages of each run.

    ``stream`` holds token numbers with separators of their own (negative
    numbers); runs over a separator are unlike all others. The suffix array is
    sorted by prefix doubling up to ``min_run`` tokens, which is enough:
    suffixes that agree on so many are neighbours, and a longer run is covered
    by the places of its parts.
    """
    n = len(stream)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, width = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    while width < min_run:
        step = min(width, min_run - width)
        nxt = np.append(rank[step:], np.full(min(step, n), -1))[:n]
        rank = np.unique(rank * (n + 2) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    suffixes = np.argsort(rank, kind="stable")  # neighbours share min_run tokens or more if their ranks are equal
    ordered, owner = rank[suffixes], page[suffixes]
    new_run = np.append(True, ordered[1:] != ordered[:-1])
    # pages stand in order in the stream, and the sort is stable
    new_page = new_run | np.append(True, owner[1:] != owner[:-1])
    return rank, np.add.reduceat(new_page.astype(np.int64), np.flatnonzero(new_run))


def _under(shared: np.ndarray, min_run: int) -> np.ndarray:
    """True for places under a run that starts where ``shared`` is true."""
    starts = np.flatnonzero(shared)
    edge = np.zeros(len(shared) + min_run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + min_run, -1)
    return np.cumsum(edge)[:len(shared)] > 0


def repeated(stream: np.ndarray, page: np.ndarray, min_run: int, min_pages: int) -> np.ndarray:
    """True for tokens inside a run of ``min_run`` tokens or more that ``min_pages`` distinct pages share."""
    rank, pages = places(stream, page, min_run)
    return _under(pages[rank] >= min_pages, min_run) if len(rank) else np.zeros(0, bool)


def _streams(pages: list[tuple[list[int], list[str]]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[str]]:
    """(stream, page, edges of each page's blocks, tokens): all blocks in order, a separator after every page."""
    ids: dict[str, int] = {}
    stream: list[int] = []
    size, edges = [], []
    for p, (_, texts) in enumerate(pages):
        at = [len(stream)]
        for text in texts:
            stream += [ids.setdefault(t, len(ids)) for t in text.split(" ")]
            at.append(len(stream))
        stream.append(-p - 1)
        edges.append(np.array(at))
        size.append(len(stream) - at[0])
    return np.array(stream, np.int64), np.repeat(np.arange(len(pages)), size), edges, list(ids)


def _main_blocks(kinds: np.ndarray, size: np.ndarray, common: np.ndarray, covered: float, copy: bool) -> np.ndarray:
    """True for the blocks that stay. ``common`` counts the tokens under runs that enough pages share; ``copy``
    says that another page has the same article, so that sharing a block with it says nothing."""
    own, hint = kinds == MAIN, kinds == MAIN_HINT
    # outside the article that a page marks, a class word is the second sign of furniture
    gone = (kinds == CHROME) | ((kinds == HINT) & (own | hint).any())
    return ~np.select([own, hint & copy, gone, hint | (kinds == HINT)],
                      [False, False, True, common >= HINT_COVERED * size], common >= covered * size)


def _salts(chunks: int) -> int:
    """Tasks that add up a host's runs: about eight chunks' runs each, and one for every chunk of smaller hosts."""
    return 1 if chunks == 1 else max(min(chunks, 64), -(-chunks // 8))


class _Chunk:
    """The runs of one host chunk of (kinds, texts) pages, with a 48-bit hash that is the same in every chunk."""

    def __init__(self, pages: list[tuple[list[int], list[str]]], min_run: int):
        self.pages, self.min_run = pages, min_run
        self.stream, owner, self.edges, self.tokens = _streams(pages)
        self.rank, found = places(self.stream, owner, min_run)
        # Plain article blocks always stay, so a run counts on the pages where it touches another block. Runs
        # inside articles decide nothing and are not sent.
        other = np.zeros(len(self.stream) + min_run, np.int64)
        for (kinds, _), at in zip(pages, self.edges):
            for k, s, e in zip(kinds, at[:-1], at[1:]):
                if k != MAIN:
                    other[s:e] = 1
        sums = np.append(0, np.cumsum(other))
        touch = sums[min_run:min_run + len(self.stream)] > sums[:len(self.stream)]
        pair = np.unique(self.rank[touch] * max(len(pages), 1) + owner[touch])
        found = np.bincount(pair // max(len(pages), 1), minlength=len(found))
        # an article with class words inside counts, whole, as one more run of its page: copies are known by it
        article = [hashlib.blake2b("\n".join(t for k, t in zip(*p) if k in (MAIN, MAIN_HINT)).encode(), digest_size=8).digest()
                   if MAIN_HINT in p[0] else b"" for p in pages]
        self.articles = sorted(set(article) - {b""})
        number = {a: len(found) + i for i, a in enumerate(self.articles)}
        self.article = [number.get(a, -1) for a in article]
        self.found = np.append(found, [article.count(a) for a in self.articles]).astype(np.int64)

    def shares(self, salts: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(runs, hashes) of every salt, in the order of the hashes; runs over a page's end are left out."""
        runs, first = np.unique(self.rank, return_index=True)
        first = first[self.found[runs] > 0]
        runs = runs[self.found[runs] > 0]
        ends = np.append(0, np.cumsum(self.stream < 0))
        stop = np.minimum(first + self.min_run, len(self.stream))
        whole = (first + self.min_run == stop) & (ends[stop] == ends[first])
        runs, first = runs[whole], first[whole]
        token = np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                          for t in self.tokens], np.uint64)
        code = np.zeros(len(runs), np.uint64)
        for j in range(self.min_run):
            code = _mix(code + token[self.stream[first + j]])
        whole = np.array([int.from_bytes(a, "little") for a in self.articles], np.uint64)
        runs = np.append(runs, len(self.found) - len(whole) + np.arange(len(whole)))
        code = np.append(code, _mix(whole)) >> np.uint64(16)
        order = np.argsort(code, kind="stable")
        runs, code = runs[order], code[order]
        salt = code % np.uint64(salts)
        return [(runs[salt == i], code[salt == i] // np.uint64(salts)) for i in range(salts)]

    def texts(self, count: np.ndarray, min_pages: int, covered: float) -> list[str]:
        """Main text of every page, where ``count`` is the number of pages of the host that hold each run."""
        sums = np.append(0, np.cumsum(_under(count[self.rank] >= min_pages, self.min_run)))
        out = []
        for (kinds, texts), at, article in zip(self.pages, self.edges, self.article):
            copy = article >= 0 and count[article] >= 2
            stay = _main_blocks(np.array(kinds, np.int64), np.diff(at), sums[at[1:]] - sums[at[:-1]], covered, copy)
            out.append("\n".join(t for t, s in zip(texts, stay) if s))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2^48 by bytes of equal weight, so that zeros lie together."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :6] = planes.T
    return wide.reshape(-1).view("<u8")


def _read_pages(table: pa.Table) -> list[tuple[list[int], list[str]]]:
    """(kinds, texts) of each row; blocks hold no line breaks."""
    return [(list(k), zlib.decompress(x).decode().split("\n") if k else [])
            for k, x in zip(table.column("kinds").to_pylist(), table.column("body").to_pylist())]


def _add_up(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """For the runs that each chunk sent under one salt of a host, the pages of the host's other chunks that hold them."""
    codes, counts = table.column("codes").to_pylist(), table.column("counts").to_pylist()
    more = []
    for s, e in zip(starts[:-1], starts[1:]):
        code = [np.cumsum(_unpack(x), dtype=np.uint64) for x in codes[s:e]]
        own = np.concatenate([_unpack(x) for x in counts[s:e]])
        run = np.unique(np.concatenate(code), return_inverse=True)[1]
        other = np.bincount(run, own).astype(np.uint64)[run] - own
        more += map(_pack, np.split(other, np.cumsum([len(c) for c in code])[:-1]))
    return pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), table.column("salt").combine_chunks(),
                                       pa.array(more, pa.binary())], ["key", "salt", "more"])


def extract(pages: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, covered: float = COVERED,
            chunk_pages: int = CHUNK_PAGES, broadcast_hosts: int = 100_000) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html)``.

    Null or empty html and pages without main text give the empty text; null
    or odd urls share the empty host; equal pages of a host give equal texts,
    and their articles are never dropped for being alike; pages without an
    article element keep the blocks that are neither furniture nor shared. An
    empty table gives an empty result. Other columns are not read.

    Runs cross blocks, not pages. An open block goes if ``covered`` of its
    tokens are under runs that ``min_pages`` pages share outside their plain
    article blocks, which always stay. A class or id word lowers a block's share to
    HINT_COVERED, inside an article only if no other page of the host has the same
    article; beside an article or main element it decides alone.
    Furniture elements go by their markup, shared or not.

    A host's pages are dealt by hash into chunks of ``chunk_pages`` on average,
    each with its own suffix array, so a busy host is many tasks' work. Every
    chunk sends the hashes of its runs with their page counts; they are added
    up by host and hash in ``_salts`` tasks, and each chunk marks its blocks by
    the sums. The result does not depend on the dealing, but for hashes that
    are equal by chance (1 in 2^48 for two runs of a host). Up to
    ``broadcast_hosts`` hosts, their chunk counts are broadcast; more are joined
    by a shuffle.
    """
    def parse(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = [blocks(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3),
                 pa.array([bytes(k for k, _ in g) for g in got], pa.binary()),
                 pa.array([zlib.compress("\n".join(t for _, t in g).encode()) for g in got], pa.binary())],
                ["page_id", "url", "host", "kinds", "body"])

    def send(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        keys, hosts_of, chunks = (table.column(c).to_pylist() for c in ("key", "host_key", "chunks"))
        out = []
        for s, e in zip(starts[:-1], starts[1:]):
            if chunks[s] > 1:
                chunk = _Chunk(_read_pages(table.slice(s, e - s)), min_run)
                for salt, (runs, code) in enumerate(chunk.shares(_salts(chunks[s]))):
                    out.append((hosts_of[s], salt, keys[s], _pack(np.diff(code, prepend=np.uint64(0))),
                                _pack(chunk.found[runs])))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                          ["host_key", "salt", "key", "codes", "counts"])

    def main_text(table: pa.Table, sums: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())], ["page_id", "url", "text"])
        chunk = _Chunk(_read_pages(table), min_run)
        count = chunk.found.copy()
        if sums.num_rows:
            shares = chunk.shares(_salts(table.column("chunks")[0].as_py()))
            for salt, more in zip(sums.column("salt").to_pylist(), sums.column("more").to_pylist()):
                count[shares[salt][0]] += _unpack(more).astype(np.int64)
        text = chunk.texts(count, min_pages, covered)
        return pa.table([table.column("page_id"), table.column("url"), pa.array(text, pa.string())],
                        ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    hosts = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / chunk_pages).alias("chunks")))
    if hosts.count() <= broadcast_hosts:
        hosts = F.broadcast(hosts)
    parsed = rows.mapInArrow(parse, "page_id long, url string, host string, kinds binary, body binary")
    chunk = F.pmod(F.xxhash64("page_id", "url"), F.col("chunks"))
    dealt = by_parts(parsed.join(hosts, "host").select(
        F.xxhash64("host", chunk).alias("key"), F.xxhash64("host").alias("host_key"), "chunks",
        "page_id", "url", "kinds", "body"), "key")
    sent = per_key(dealt, ["key"], send, "host_key long, salt int, key long, codes binary, counts binary")
    sums = by_parts(per_key(sent, ["host_key", "salt"], _add_up, "key long, salt int, more binary"), "key")
    return dealt.groupBy("key").cogroup(sums.groupBy("key")).applyInArrow(
        main_text, "page_id long, url string, text string")
