"""The registered queries of this subpackage and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (audit, chat, decontam, html, langid, neardup, packing, phrases, pieces, quality, sharding,
                          simhash, urls)
from tidemark.llm.common import in_split

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
SPECIAL = "<|im_end|><|im_start|>assistant ok"


def query(name: str, oracle: str | None = None):
    def add(fn: Build) -> Build:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 4096 token ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.train(docs, split=(4, 2)))
    return got.select("doc_id", in_split("doc_id", 4, 2).alias("held_out"), "lang_pred", "score",
                      "runner_up", "ambiguous")


# DuckDB: every pair, then the transitive closure.
OP3 = """
with recursive v as (
  select vec_id, case when embedding is not null and len(embedding) > 0
      and list_bool_and([x is not null and isfinite(x) for x in embedding]) and
      list_bool_or([x <> 0 for x in embedding]) then embedding::double[] end as e
  from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, reach) as (
  select vec_id, vec_id from v union select r.vec_id, l.b from r join l on l.a = r.reach),
c as (select vec_id, min(reach) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n_links from l group by a)
select c.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, c.vec_id = c.component_id as kept
from c left join n using (vec_id)
"""


@query("op3_embedding_near_dedup", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.95, with their components."""
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op4_byte_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by SimHash fingerprints of 3-word shingles at 3 bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


# DuckDB: window functions for the spans; history and system turns are counted, not written.
OP6 = """
with t0 as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t1 as (
  select *, row_number() over w as rn,
    len(regexp_extract_all(text, '\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]')) + 4 as tok,
    length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n|')) + 13
      + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + 11 as n
  from t0 window w as (partition by conv_id order by turn, role, text)),
t2 as (select *, rn = 1 and role = 'system' as sys from t1),
t3 as (
  select *, greatest(512 - max(case when sys then tok else 0 end) over (partition by conv_id) - 128, 128) as fresh,
    max(case when sys then n end) over (partition by conv_id) as sys_n,
    coalesce(sum(case when sys then 0 else tok end) over
      (partition by conv_id order by rn rows between unbounded preceding and 1 preceding), 0) as cum
  from t2),
t4 as (
  select *, (2 * cum) // fresh as span,
    sum(case when not sys and tok * 2 > fresh then 1 else 0 end) over (partition by conv_id order by rn) as longs
  from t3),
t5 as (
  select *, lag(sys) over w as was_sys, lag(span) over w as s1, lag(longs) over w as l1,
    lag(case when not sys then n end, 1) over w as n1, lag(cum, 1) over w as c1,
    lag(case when not sys then n end, 2) over w as n2, lag(cum, 2) over w as c2
  from t4 window w as (partition by conv_id order by rn)),
t6 as (
  select *, s1 is not null and not was_sys and (span <> s1 or longs <> l1) as opens_later from t5)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by rn), '')) as loss_sha256,
  cast(sum(n + case when opens_later then coalesce(sys_n, 0)
      + case when n1 is not null and cum - c1 <= 128 then n1 else 0 end
      + case when n2 is not null and cum - c2 <= 128 then n2 else 0 end else 0 end) as bigint) as formatted_chars
from t6 group by conv_id
"""


@query("op6_chat_formatting", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    cols = ["conv_id", "turn", "role", "text"]
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPECIAL).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(*cols).unionByName(own)
    return chat.read_back(chat.format_windows(rows))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    got = html.extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# DuckDB: every document window as a string.
OP8 = r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as s
  from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select doc_id, i, dw.n, item from dw join bw on dw.n = bw.n and dw.s = bw.s),
c as (select doc_id, count(distinct p) as n_hit
      from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
       from (select distinct doc_id, item from h) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join it using (doc_id)
"""


@query("op8_decontamination", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    got = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.drop("items")


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of ``pages``: the page id gives the fetch time, a minute of the year 2024."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("capture_id"), "url",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((page_id * 7919) % 525600 as int))")
        .alias("fetched"))


def _hash(text: str, at: int):
    return F.conv(F.expr(f"substr(md5({text}), {at}, 6)"), 16, 10).cast("long")


def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries for the pages' hosts, all label suffixes, all path prefixes and the pages with their query, as in ``OP9``.

    Two lists with four changes each per key; an md5 of list, key and number
    gives the day and the action, and half the changes are left out. Entries are written in different forms (bare,
    with ``www.``, as a URL with upper-case scheme and a fragment, with an empty path step), which the operator evens out.
    """
    keys = (table(spark, sf_dir, "pages").select(F.explode(urls.lookup_keys(F.col("url"))).alias("key")).distinct())
    changes = keys.select("key", F.explode(F.array(F.lit("malware"), F.lit("spam"))).alias("list_name")).select(
        "key", "list_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("nth"))
    tag = "concat(list_name, '|', key, '|', nth)"
    form, whole = _hash(tag, 13) % 4, F.contains("key", F.lit("?"))
    written = (F.when(form == 1, F.concat(F.lit("www."), F.col("key")))
               .when(form == 2, F.concat(F.lit("HTTPS://www."), F.col("key"), F.lit("#top")))
               .when((form == 3) & ~whole, F.concat("key", F.lit("/"))).otherwise(F.col("key")))
    return (changes.withColumn("day", _hash(tag, 1) % 366).withColumn("what", _hash(tag, 7) % 6)
            .filter("what < 3")
            .select("list_name", written.alias("key"), F.element_at(F.array(F.lit("block"), F.lit("drop"), F.lit("allow")),
                                                     (F.col("what") + 1).cast("int")).alias("action"),
                    F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(day as int))").alias("since")))


OP9 = r"""
with c as (
  select page_id as capture_id, url,
    timestamp '2024-01-01 00:00:00' + to_minutes(cast((page_id * 7919) % 525600 as bigint)) as fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''),
      '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') as host,
    [x for x in string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')
      if x <> ''] as steps,
    regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*(\?[^#]*)', 1) as ask
  from pages),
k0 as (
  select capture_id, url, fetched, list_distinct(
    [array_to_string(list_concat([host], steps[1:i]), '/') for i in range(1, len(steps) + 1)]
    || case when ask <> '' then [array_to_string(list_concat([host], steps), '/') || ask] else [] end
    || [array_to_string(string_split(host, '.')[i:], '.')
        for i in range(1, len(string_split(host, '.')) + 1)]) as keys
  from c where host <> ''),
k as (select capture_id, url, fetched, unnest(keys) as key from k0),
e0 as (
  select key, list_name, nth, list_name || '|' || key || '|' || nth as tag
  from (select distinct key from k), (values ('malware'), ('spam')) l(list_name), range(4) r(nth)),
e1 as (
  select list_name, key, cast('0x' || substr(md5(tag), 1, 6) as bigint) % 366 as day,
    cast('0x' || substr(md5(tag), 7, 6) as bigint) % 6 as what from e0),
e2 as (
  select list_name, key, timestamp '2024-01-01 00:00:00' + to_days(cast(day as int)) as since,
    max(case what when 0 then 'block' when 1 then 'drop' else 'allow' end) as action
  from e1 where what < 3 group by all),
iv as (
  select list_name, key, action, since, coalesce(lead(since) over (partition by list_name, key order by since),
    timestamp '9999-12-31 00:00:00') as until from e2),
a as (
  select k.capture_id, k.url, k.fetched, iv.key, iv.action, iv.list_name
  from k join iv on k.key = iv.key and k.fetched >= iv.since and k.fetched < iv.until and iv.action <> 'drop'),
best as (
  select *, row_number() over (partition by capture_id, url, fetched
      order by length(key) desc, key, action, list_name) as rn,
    count(*) over (partition by capture_id, url, fetched) as n_active
  from a)
select c.capture_id, c.url, c.fetched, coalesce(n_active, 0) as n_active, coalesce(action, 'pass') as verdict,
  key as rule_key, list_name as rule_list
from c left join best on rn = 1 and best.capture_id = c.capture_id and best.url = c.url and best.fetched = c.fetched
"""


@query("op9_url_temporal_lists", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the list entries active at its fetch time."""
    return urls.evaluate(url_captures(spark, sf_dir), url_entries(spark, sf_dir))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    got = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), split=(5, 0)), 0.3)
    return got.select("doc_id", in_split("doc_id", 5, 0).alias("held_out"), "score", "predicted")


# DuckDB: every occurrence of 1 to 5 words, counted; then the cuts of the frequent ones.
OP11 = r"""
with p as (
  select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
nn as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, m, w, unnest(range(1, len(w) - m + 2)) as i from w, range(1, 6) t(m) where len(w) >= m),
f as (select lang, cast(m as int) as m, w[i:i + m - 1] as ws, count(*) as a from g group by all having count(*) >= 100),
c as (select lang, m, ws, a, unnest(range(1, m)) as k from f where m > 1),
s as (
  select c.lang, c.m, c.ws, c.a, k, x.a as l, y.a as r, n,
    cast((cast(c.a as hugeint) * n * 1000) // (cast(x.a as hugeint) * y.a) as bigint) as score
  from c join f x on x.lang = c.lang and x.ws = c.ws[1:k] join f y on y.lang = c.lang and y.ws = c.ws[k + 1:c.m]
    join nn on nn.lang = c.lang),
b as (select * from s qualify row_number() over (partition by lang, ws order by score, k) = 1),
sub as (
  select distinct lang, ws[i:j] as ws, a
  from (select *, unnest(range(i + 1, m + 1)) as j from (select *, unnest(range(1, m)) as i from f where m > 2))
  where j - i + 1 < m),
o as (
  select b.lang, array_to_string(b.ws, ' ') as phrase, b.a, l, r, n, score
  from b where not exists (select 1 from sub where sub.lang = b.lang and sub.ws = b.ws and 100 * sub.a >= 100 * b.a))
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
where rank <= 2000
"""


@query("op11_phrase_collocations", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to five words."""
    return phrases.collocations(table(spark, sf_dir, "documents"), 100, 5, 2000)


@query("op12_piece_encoding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids and what they decode to."""
    got = pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))
    return got.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


# DuckDB: the filters each text fails, then every step of every order over the counts of the 32 combinations.
OP13 = r"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (
  select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
      100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) over (partition by text), false)] as f,
    coalesce(q, false) as good, coalesce(x, false) as toxic
  from t left join (select doc_id, bool_or(quality = 1) as q, bool_or(toxic = 1) as x from labels group by doc_id)
    using (doc_id)),
c as (
  select part, f, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from x group by part, f),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
s as (select filter_order, step, ascii(filter_order[step]) - 64 as own,
        [ascii(filter_order[i]) - 64 for i in range(1, step)] as earlier
      from o, range(1, 6) r(step)),
y as (
  select part, filter_order, step, own, n, good, toxic, f[own] as fails,
    len([i for i in earlier if f[i]]) > 0 as gone, len([b for b in f if b]) as failed
  from c, s),
z as (
  select part, filter_order, cast(step as int) as step, any_value(own) as own,
    coalesce(sum(n) filter (where not gone and not fails), 0)::bigint as kept,
    coalesce(sum(n) filter (where not gone and fails), 0)::bigint as removed,
    coalesce(sum(n) filter (where gone and fails), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails and failed = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where not gone and fails), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where not gone and fails), 0)::bigint as toxic_lost
  from y group by part, filter_order, step)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from z
"""


@query("op13_filter_audit", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in every order."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
