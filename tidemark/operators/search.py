"""Full-text search over tasks.

Documents are ``task || ' ' || category || ' ' || tags`` (NULL parts empty).
Normalisation: lower case, tokens = runs of letters/digits, positions count
every token (stop words too), stop words dropped, then the S-stemmer
(Harman 1991). This approximates an English dictionary; forms such as -ing
are not reduced.

Plan shape: the postings (doc, lexeme, position) are built with
``regexp_extract_all`` + ``posexplode`` (no UDF). Query terms are one row
per user and term, joined without a hint. The occurrences of query
terms are then gathered per document in one shuffle (they come from a
single row, so the per-document list is bounded by that row's text), and
matching (all terms present) and relevance are expressions over that
list. Relevance needs position pairs of different query terms: pairs at most
100 tokens apart are visited (each occurrence has at most the next 100 as
partners), and all farther pairs weigh the same, so they are only counted. Top-k per user uses
``row_number() <= k``, which Spark limits per map task before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import with_project_name
from tidemark.operators.lists import top_n

# English stop words (the common Snowball list), in its order.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now",
]
TOKEN_RE = r"[\p{L}\p{N}]+"
# Fixed values of the rank: default weight of unlabelled lexemes, sum of 1/k^2, distance cut-off.
WEIGHT = 0.1
ZETA2 = 1.64493406685
MAX_DIST = 100
FAR_WEIGHT = 1e-30
EMPTY_RANK = 1e-20


def document(tasks: DataFrame) -> Column:
    """I1 document text: task, metadata category and tags (NULL -> '')."""
    return F.concat_ws(" ", F.coalesce(F.col("task"), F.lit("")),
                       F.coalesce(F.get_json_object("metadata", "$.category"), F.lit("")),
                       F.coalesce(F.get_json_object("metadata", "$.tags"), F.lit("")))


def stem(w: Column) -> Column:
    """S-stemmer: ies->y (not eies/aies), es->e (not aes/ees/oes), s->'' (not us/ss)."""
    n = F.length(w)
    return (F.when(w.endswith("ies") & ~w.endswith("eies") & ~w.endswith("aies"),
                   F.concat(F.call_function("substr", w, F.lit(1), n - 3), F.lit("y")))
            .when(w.endswith("es") & ~w.endswith("aes") & ~w.endswith("ees") & ~w.endswith("oes"),
                  F.call_function("substr", w, F.lit(1), n - 1))
            .when(w.endswith("s") & ~w.endswith("us") & ~w.endswith("ss"),
                  F.call_function("substr", w, F.lit(1), n - 1))
            .otherwise(w))


def tokens(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """(keys, pos, lexeme): positions count all tokens; stop words are dropped after."""
    stops = F.array(*[F.lit(s) for s in STOP_WORDS])
    t = df.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)).alias("pos", "tok"))
    return (t.where(~F.array_contains(stops, F.col("tok")))
            .select(*keys, (F.col("pos") + 1).alias("pos"), stem(F.col("tok")).alias("lexeme")))


def search_postings(tasks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, lexeme, positions) with sorted positions per document and lexeme."""
    keys = keys or ["user_id"]
    toks = tokens(tasks, document(tasks), [*keys, "id"])
    return toks.groupBy(*keys, "id", "lexeme").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def query_terms(queries: DataFrame, query_col: str = "query", keys: list[str] | None = None) -> DataFrame:
    """Distinct normalised terms of each query (an all-stop-word query has none)."""
    keys = keys or ["user_id"]
    return tokens(queries, F.col(query_col), keys).select(*keys, "lexeme").distinct()


def occurrences(tasks: DataFrame, queries: DataFrame, keys: list[str] | None = None,
                payload: list[str] | None = None) -> DataFrame:
    """Positions of query terms in the querying user's documents: (keys, id, lexeme, pos, n_terms, payload).

    The query side has one row per user and term, so it grows with the users
    and gets no broadcast hint; the documents are tokenized once. ``payload``
    columns of the document ride along.
    """
    keys = keys or ["user_id"]
    payload = payload or []
    terms = query_terms(queries, keys=keys)
    # a user's terms are bounded by the text of their query
    qt = terms.withColumn("n_terms", F.count("*").over(Window.partitionBy(*keys)))
    toks = tokens(tasks, document(tasks), [*keys, "id", *payload])
    return toks.join(qt, [*keys, "lexeme"])


def doc_hits(tasks: DataFrame, queries: DataFrame, keys: list[str] | None = None,
             payload: list[str] | None = None) -> DataFrame:
    """Per matching document: (keys, id, n_terms, n_pos, occs).

    One shuffle by document: the occurrences of query terms in a document
    come from that one row, so gathering them per document is bounded by
    the row's own text. ``occs`` is sorted by position.
    """
    keys = keys or ["user_id"]
    payload = payload or []
    occ = occurrences(tasks, queries, keys, payload)
    per_doc = occ.groupBy(*keys, "id").agg(
        *[F.max(c).alias(c) for c in payload],
        F.max("n_terms").alias("n_terms"), F.size(F.collect_set("lexeme")).alias("n_found"),
        F.count("*").alias("n_pos"), F.sort_array(F.collect_list(F.struct("pos", "lexeme"))).alias("occs"))
    return per_doc.where(F.col("n_found") == F.col("n_terms")).drop("n_found")


def search_match(tasks: DataFrame, queries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Documents of the querying user containing every query term."""
    keys = keys or ["user_id"]
    return doc_hits(tasks, queries, keys).select(*keys, "id", "n_terms")


def _word_distance(d: Column) -> Column:
    """wd of a near pair; pairs beyond MAX_DIST have FAR_WEIGHT."""
    return F.lit(1.0) / (F.lit(1.005) + F.lit(0.05) * F.exp(d / F.lit(1.5) - F.lit(2.0)))


def rank_expr(n_terms: Column, n_pos: Column, occs: Column) -> Column:
    """Relevance (REAL) from the sorted occurrences of the query terms in one document.

    One distinct term: 0.1 * sum_{k=1..n} 1/k^2 / 1.64493406685 over its n
    positions. Several: 1 - prod(1 - sqrt(0.1 * 0.1 * wd(dist))) over the
    position pairs of different terms, wd(d) = 1/(1.005 + 0.05 exp(d/1.5 - 2)).
    Positions are distinct and sorted, so every partner within MAX_DIST of
    element i lies in the next MAX_DIST elements: the pair scan is bounded
    by MAX_DIST per occurrence. All farther pairs have wd = 1e-30: their
    number (pairs of different terms less the near ones) times one logarithm.
    """
    single = F.lit(WEIGHT) * F.aggregate(
        F.sequence(F.lit(1), n_pos.cast("int")), F.lit(0.0),
        lambda acc, k: acc + F.lit(1.0) / (k * k).cast("double")) / F.lit(ZETA2)

    def near_sum(acc, i):
        me = F.element_at(occs, i)
        nxt = F.filter(F.slice(occs, i + 1, MAX_DIST),
                       lambda o: (o["lexeme"] != me["lexeme"]) & (o["pos"] - me["pos"] <= MAX_DIST))
        part = F.aggregate(nxt, F.lit(0.0), lambda a, o: a + F.log1p(
            -F.sqrt(F.lit(WEIGHT * WEIGHT) * _word_distance((o["pos"] - me["pos"]).cast("double")))))
        return F.struct((acc["log"] + part).alias("log"), (acc["pairs"] + F.size(nxt)).alias("pairs"))

    near = F.aggregate(F.sequence(F.lit(1), F.size(occs)),
                       F.struct(F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("pairs")), near_sum)
    # pairs of different terms: half of (all ordered pairs less those of one term)
    lexemes = F.transform(occs, lambda o: o["lexeme"])
    same = F.aggregate(F.array_distinct(lexemes), F.lit(0).cast("long"),
                       lambda a, x: a + F.pow(F.size(F.filter(lexemes, lambda y: y == x)), F.lit(2)).cast("long"))
    pairs = (F.size(occs).cast("long") * F.size(occs) - same) / 2
    far = math.log1p(-math.sqrt(WEIGHT * WEIGHT * FAR_WEIGHT))
    log_keep = near["log"] + (pairs - near["pairs"]) * F.lit(far)
    multi = F.when(log_keep < 0, -F.expm1(log_keep))
    r = F.when(n_terms == 1, single).otherwise(multi)
    r = F.coalesce(r, F.lit(EMPTY_RANK))
    return F.when(r <= 0, F.lit(EMPTY_RANK)).otherwise(r).cast("float")


def search_rank(tasks: DataFrame, queries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """I4: relevance of each matching document (REAL, as the default ranking)."""
    keys = keys or ["user_id"]
    h = doc_hits(tasks, queries, keys)
    return h.select(*keys, "id", rank_expr(F.col("n_terms"), F.col("n_pos"), F.col("occs")).alias("relevance_score"))


def search_tasks(tasks: DataFrame, projects: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """I5 + F3: each user's active matching tasks with project name, best ``k`` by
    relevance desc, created_at desc (id desc breaks the remaining ties)."""
    active = tasks.where(F.col("archived") == F.lit(False))
    h = doc_hits(active, queries, payload=["task", "project_id", "priority", "created_at"])
    rows = h.select("user_id", "id", "task", "project_id", "priority", "created_at",
                    rank_expr(F.col("n_terms"), F.col("n_pos"), F.col("occs")).alias("relevance_score"))
    rows = with_project_name(rows, projects)
    top = top_n(rows, ["user_id"], [F.col("relevance_score").desc(), F.col("created_at").desc(),
                                    F.col("id").desc()], k, "result_pos")
    return top.select("user_id", "result_pos", "id", "task", "project_name", "priority", "created_at",
                      "relevance_score")


PARTS = 16       # parts of a user's postings in one bucket
TASKS_TIMES = 4  # tasks that write postings, as a multiple of the session's shuffle partitions


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int")


def store_postings(postings: DataFrame, path: str, buckets: int = 16) -> DataFrame:
    """Write postings (I1) to the folder ``path``, one subfolder per hash bucket of the lexeme.

    A folder per lexeme would be one per word of the language; ``buckets``
    bounds their number, and a search opens only the buckets of its terms.
    A user's part of a bucket is ``PARTS`` tasks' work by the id, so a frequent word is not one task's
    sort, and the number of tasks is given, for adaptive coalescing goes by packed bytes and not by what a task sorts.
    """
    n = TASKS_TIMES * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (postings.withColumn("bucket", _bucket(buckets))
     .repartition(n, "bucket", "user_id", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
     .write.partitionBy("bucket").parquet(path))
    return postings.sparkSession.read.parquet(path)


def search_stored(postings: DataFrame, tasks: DataFrame, projects: DataFrame, queries: DataFrame, k: int = 50,
                  buckets: int = 16) -> DataFrame:
    """I5 + F3 over stored postings (of ``store_postings`` or the stream J7): the rows of ``search_tasks``.

    No text is tokenized but the queries'. Terms meet postings on (user,
    lexeme), and the bucket if they are stored by it; a document's positions
    come from that one document. Only ids and dates of the tasks take part in
    the ranking; whole rows are read for the best ``k`` of a user.
    """
    on = ["user_id", "lexeme"]
    terms = query_terms(queries).withColumn("n_terms", F.count("*").over(Window.partitionBy("user_id")))
    if "bucket" in postings.columns:
        terms, on = terms.withColumn("bucket", _bucket(buckets)), [*on, "bucket"]
    occs = F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("lexeme").alias("lexeme")))
    found = (postings.join(terms, on).groupBy("user_id", "id")
             .agg(F.max("n_terms").alias("n_terms"), F.count("*").alias("n_found"),
                  F.sort_array(F.flatten(F.collect_list(occs))).alias("occs"))
             .where(F.col("n_found") == F.col("n_terms")))
    active = tasks.where(F.col("archived") == F.lit(False)).select("user_id", "id", "created_at")
    ranked = (found.join(active, ["user_id", "id"])
              .select("user_id", "id", "created_at",
                      rank_expr(F.col("n_terms"), F.size("occs"), F.col("occs")).alias("relevance_score")))
    best = top_n(ranked, ["user_id"], [F.col("relevance_score").desc(), F.col("created_at").desc(),
                                       F.col("id").desc()], k, "result_pos")
    rows = best.join(tasks.select("user_id", "id", "task", "project_id", "priority"), ["user_id", "id"])
    return with_project_name(rows, projects).select("user_id", "result_pos", "id", "task", "project_name", "priority",
                                                    "created_at", "relevance_score")


def _check_constants():
    assert math.isclose(ZETA2, math.pi ** 2 / 6, rel_tol=1e-10)


_check_constants()
