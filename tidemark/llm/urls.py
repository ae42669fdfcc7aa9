"""URL filters by a temporal list join.

List entries are dated: ``add`` puts a rule into force and ``drop`` ends it.
Entries become validity intervals per rule; every capture is looked up under
its host, its parent domains, all its path prefixes and its page, as of its
fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

FAR = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a leading ``www.``; empty if the text is no URL."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*(\?[^#]*)", 1)


def _steps(url: Column) -> Column:
    return F.array_remove(F.split(path_of(url), "/"), "")


def rule_key(key: Column) -> Column:
    """A list entry's key as captures are looked up: host as of ``host_of``, path without empty steps, query if any.

    Entries are hosts, domains, single labels, host/path or whole URLs; null if nothing of a host is left.
    """
    text = F.trim(key)
    url = F.when(text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), text).otherwise(F.concat(F.lit("http://"), text))
    host = host_of(url)
    return F.when(host != "", F.concat(F.array_join(F.concat(F.array(host), _steps(url)), "/"), _query_of(url)))


def lookup_keys(url: Column, path_levels: int | None = None, min_labels: int = 1) -> Column:
    """Keys of a URL: the page with its query, ``host/first/second/...`` for every path prefix, host, parent domains.

    ``path_levels`` bounds the path prefixes and leaves out the query; domains have ``min_labels`` labels or more.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - (min_labels - 1), F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = _steps(url)
    depth = F.size(steps) if path_levels is None else F.least(F.size(steps), F.lit(path_levels))
    paths = F.transform(F.filter(F.sequence(F.lit(0), depth), lambda n: n > 0),
                        lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))
    keys = F.concat(paths, domains) if path_levels is not None else F.concat(
        F.array(F.when(_query_of(url) != "", rule_key(url))), paths, domains)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(keys)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, key, action, valid_from, valid_to) from ``entries(list_name, key, action, since)``.

    ``action`` is ``block``, ``allow`` or ``drop``. An entry holds from its
    time to that of the next entry of the same list and key; ``drop`` opens no
    interval. Of entries with equal times, list and key the last action by
    name holds (drop over block over allow); repeated entries change nothing;
    entries without key or time are not in force. Keys are brought to the form
    of ``rule_key``; keys that are then equal are one key.
    """
    at = (entries.withColumn("key", rule_key(F.col("key"))).filter("key is not null and since is not null")
          .groupBy("list_name", "key", "since").agg(F.max("action").alias("action")))
    w = Window.partitionBy("list_name", "key").orderBy("since")
    return (at.withColumn("valid_to", F.coalesce(F.lead("since").over(w), F.lit(FAR).cast("timestamp_ntz")))
            .filter("action <> 'drop'")
            .select("list_name", "key", "action", F.col("since").alias("valid_from"), "valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame, path_levels: int | None = None) -> DataFrame:
    """(capture_id, url, fetched, n_active, verdict, rule_key, rule_list) for every capture.

    ``captures(capture_id, url, fetched)``. Active are the entries under any
    of the URL's keys whose interval holds ``fetched`` (from included, to
    excluded). The longest key decides; of equal keys ``allow`` goes before
    ``block``, then the list's name. Without an active entry, for a null time
    and for a text that is no URL the verdict is ``pass``. Equal captures give
    equal rows; both tables may be empty; other columns are not read.

    A capture row has at most a key per path step and label, and one for its query. The join is on the
    key: a busy host's captures can be split over tasks, because the list side
    of a key holds only that rule's own changes.
    """
    own = ["capture_id", "url", "fetched"]
    rows = captures.groupBy(*own).agg(F.count("*").alias("copies"))
    keyed = rows.select(*own, "copies", F.explode_outer(lookup_keys(F.col("url"), path_levels)).alias("at"))
    # written out, so that both sides of the join are plain shuffles and a busy key can be split
    valid = cut(intervals(entries))
    active = keyed.join(valid, (F.col("at") == F.col("key")) & (F.col("fetched") >= F.col("valid_from"))
                        & (F.col("fetched") < F.col("valid_to")), "left")
    rule = F.struct((-F.char_length("key")).alias("short"), "key", "action", "list_name")
    best = active.groupBy(*own, "copies").agg(F.count("key").alias("n_active"),
                                              F.min(F.when(F.col("key").isNotNull(), rule)).alias("best"))
    return best.select(*own, "n_active", F.coalesce("best.action", F.lit("pass")).alias("verdict"),
                       F.col("best.key").alias("rule_key"), F.col("best.list_name").alias("rule_list"),
                       F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
