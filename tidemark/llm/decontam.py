"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Windows of 13 item words are sets of word shingles. One pass over the
documents finds every place where a benchmark shingle stands and counts how
rare each is in the corpus. A window can only occur where its rarest shingle
does, so that one shingle is the window's necessary prefix: its places give
the candidates, length and positional bounds thin them, and the other shingles
at their exact places verify them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words, after A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
BROADCAST_ROWS = 100_000  # benchmark shingles up to which the dictionary is broadcast
BLOCK = 256  # document places that one row of the verification holds


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() is much faster than translate() and the same on ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAPS), "")


def _shingles(ws: Column, k: int) -> Column:
    """Array of (w0, w1, w2) at every word; places past the last shingle hold a null and join with nothing."""
    cols = [ws] + [F.slice(ws, i + 1, F.greatest(F.size(ws), F.lit(1))) for i in range(1, k)]
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(cols)])
    if k == SHINGLE:
        return zipped
    return F.transform(zipped, lambda z: F.struct(*[z[f"w{i}"].alias(f"w{i}") if i < k else F.lit("").alias(f"w{i}")
                                                    for i in range(SHINGLE)]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", share: int = 20,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, n_words, n_hit, items, n_items, items_sha256, contaminated) for every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. n_hit counts the document's words
    inside any occurrence of a window; items holds the ids (as text, sorted)
    of items with occurring windows; contaminated if n_hit > 0 and
    ``share`` * n_hit >= n_words.

    Null texts have no words and are never contaminated; items without words
    are not looked for; equal items each count; rows with equal ids keep a row
    each; a null item id is the empty text; an empty table of either kind
    works. Other columns are not read.

    A candidate is verified against the BLOCK-sized pieces of the document that
    its item would cover, so a long document full of candidates costs their
    number times the item's size, in many rows. The documents are read once.
    The dictionary of benchmark shingles is
    broadcast if it has at most ``broadcast_rows`` rows; a larger one is
    joined by shuffling shingles, without a change of the result.
    """
    items = cut(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                                 words(F.col(text_col)).alias("ws"))
                .filter(F.size("ws") > 0)
                .withColumn("iid", F.monotonically_increasing_id())
                .withColumn("n", F.size("ws"))
                .withColumn("k", F.least("n", F.lit(SHINGLE)))
                .withColumn("wlen", F.least("n", F.lit(window)))
                .withColumn("need", F.expr("wlen - k + 1")))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # of 1, 2 and 3

    grams = None
    for k in sizes:
        part = (items.filter(F.col("k") == k)
                .select("iid", F.posexplode(_shingles(F.col("ws"), k)).alias("off", "g"))
                .select("iid", "off", "g.*").na.drop())
        grams = part if grams is None else grams.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("ws"))
    if grams is None:
        return _result(texts.select("id", F.size("ws").cast("long").alias("n_words")), None, id_col, share)

    keys = [f"w{i}" for i in range(SHINGLE)]
    mark = F.struct(*[F.lit("").alias(k) for k in keys])  # one row per document, found or not
    dictionary = cut(grams.select(*keys).distinct().withColumn("sid", F.monotonically_increasing_id())
                     .unionByName(items.sparkSession.range(1).select(*[F.lit("").alias(k) for k in keys],
                                                                     F.lit(-1).cast("long").alias("sid"))))
    small = dictionary.count() <= broadcast_rows
    placed = F.concat(F.array(mark), *[_shingles(F.col("ws"), k) for k in sizes])
    places = (texts.withColumn("rid", F.monotonically_increasing_id())
              .select("rid", "id", F.size("ws").alias("n_words"), F.posexplode(placed).alias("pos", "g"))
              .select("rid", "id", "n_words", "pos", "g.*"))
    # written out: row numbers and places stay the same if a task runs again
    seen = cut(places.join(F.broadcast(dictionary) if small else dictionary, keys)
               .select("rid", "id", "n_words", "sid",
                       # sizes stand one after the other: each list has n_words places
                       F.expr("(pos - 1) % greatest(n_words, 1)").alias("pos")))
    found = seen.filter("sid >= 0")

    # rarity over the whole corpus, and the rarest shingle of every window
    rarity = found.groupBy("sid").agg(F.count("*").alias("rare"))
    grams = cut(grams.join(dictionary, keys).select("iid", "off", "sid")
                .join(rarity, "sid", "left").na.fill(0, ["rare"]))
    prefix = (grams.join(items.select("iid", "n", "wlen", "need"), "iid")
              .select("iid", "off", "sid", "rare", "wlen", "need",
                      F.explode(F.sequence(F.greatest(F.lit(0), F.expr("off - need + 1")),
                                           F.least(F.col("off"), F.expr("n - wlen")))).alias("w"))
              .groupBy("iid", "w", "wlen", "need")
              .agg(F.min(F.struct("rare", "sid", "off")).alias("p")).filter("p.rare > 0")
              .groupBy("iid", "wlen", "need", F.col("p.sid").alias("sid"), F.col("p.off").alias("off"))
              .agg(F.min("w").alias("w_low"), F.max("w").alias("w_high")))
    lists = (grams.groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("off", "sid"))).alias("l"))
             .select("iid", F.col("l.sid").alias("sids")))  # one item's own shingles

    # a candidate: item word 0 would stand at word `at` of the document; some window of the prefix must fit
    cand = (found.join(prefix, "sid").withColumn("at", F.expr("pos - off"))
            .filter(F.expr("greatest(w_low, -at) <= least(w_high, n_words - wlen - at)"))
            .select("rid", "iid", "at", "n_words", "wlen", "need").distinct())
    # the document's own places, block by block: a candidate meets the blocks that its item would cover
    own = (found.join(cand.select("rid").distinct(), "rid", "left_semi")
           .groupBy("rid", F.expr(f"pos div {BLOCK}").alias("block"))
           .agg(F.collect_list(F.struct("pos", "sid")).alias("own")))
    checked = (cand.join(lists, "iid")
               .withColumn("block", F.explode(F.expr(
                   f"sequence(greatest(at, 0) div {BLOCK}, (least(at + size(sids), n_words) - 1) div {BLOCK})")))
               .join(own, ["rid", "block"])
               .withColumn("run", F.expr("transform(filter(own, o -> get(sids, o.pos - at) = o.sid), o -> o.pos)"))
               .filter("size(run) > 0")
               .groupBy("rid", "iid", "at", "wlen", "need")
               .agg(F.array_sort(F.flatten(F.collect_list("run"))).alias("run"))
               .filter("size(run) >= need")
               .withColumn("starts", F.expr(
                   "filter(run, (p, i) -> coalesce(get(run, i + need - 1), -1) = p + need - 1)"))
               .filter("size(starts) > 0"))
    checked = cut(checked.select("rid", "iid", "wlen", "starts"))
    # one span for each place where some window starts, however many items share it
    covered = (checked.select("rid", F.explode("starts").alias("s"), "wlen")
               .groupBy("rid", "s").agg(F.max("wlen").alias("wlen"))
               .groupBy("rid").agg(F.array_sort(F.collect_list(F.expr("struct(s as s, s + wlen as e)"))).alias("spans"))
               .select("rid", F.expr("""aggregate(spans, struct(0 as far, 0L as hit),
                   (a, x) -> struct(greatest(a.far, x.e) as far,
                                    a.hit + greatest(0, x.e - greatest(a.far, x.s)) as hit)).hit""").alias("n_hit")))
    hits = (checked.join(items.select("iid", "item"), "iid")
            .groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items")).join(covered, "rid"))
    rows = seen.filter("sid = -1").select("rid", "id", F.col("n_words").cast("long").alias("n_words"))
    return _result(rows, hits, id_col, share)


def _result(rows: DataFrame, hits: DataFrame | None, id_col: str, share: int) -> DataFrame:
    none = F.array().cast("array<string>")
    if hits is None:
        out = rows.withColumn("items", none).withColumn("n_hit", F.lit(0).cast("long"))
    else:
        out = (rows.join(hits, "rid", "left").withColumn("items", F.coalesce("items", none))
               .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items",
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
