"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history: on a date an entry for a host, for a domain and all hosts below it, or for a
path prefix of a host is added to or removed from a category. Each entry's events become intervals
in which it is active. A capture is looked up under the keys its url gives (its host, each domain
above it, each folder of its path), and the intervals that hold its fetch time decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The end of an interval that no event ends.
FAR = "9999-12-31 00:00:00"


def intervals(events: DataFrame) -> DataFrame:
    """``kind, key, category, valid_from, valid_to`` from events (kind, key, category, action, ts).

    An entry is active from an ``add`` up to (not with) the next ``remove``; adds while it is active
    and removes while it is not change nothing; of events at one time the remove comes last and so
    holds. Nulls in any column drop the event. One window by entry: events of one entry are few.
    """
    w = Window.partitionBy("kind", "key", "category").orderBy("ts")
    one = events.where("kind is not null and key is not null and category is not null and ts is not null and action in ('add', 'remove')").groupBy(
        "kind", F.lower("key").alias("key"), "category", "ts"
    ).agg(F.max("action").alias("action"))
    turns = one.withColumn("before", F.lag("action", 1, "remove").over(w)).where("action <> before")
    spans = turns.withColumn("valid_to", F.coalesce(F.lead("ts").over(w), F.lit(FAR).cast("timestamp")))
    return spans.where("action = 'add'").select("kind", "key", "category", F.col("ts").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    """Lower-case host of a url, without user, port and a trailing dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    found = F.regexp_replace(found, r"\.$", "")
    return F.when(found != "", found)


def path(url: Column) -> Column:
    """Path of a url without query and fragment; "/" where it is empty."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def keys(url: Column) -> Column:
    """Array of (kind, key) under which a url may be listed; null where it has no host."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    steps = F.split(p, "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(h, F.array_join(F.slice(steps, 1, i), "/"), F.when(i < F.size(steps), F.lit("/")).otherwise(F.lit(""))).alias("key")),
    )
    exact = F.array(F.struct(F.lit("host").alias("kind"), h.alias("key")))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(exact, domains, F.transform(folders, lambda x: F.struct(x["kind"].alias("kind"), F.lower(x["key"]).alias("key"))))))


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Each capture (capture_id, url, fetched) with ``categories`` active at its fetch time and ``blocked``.

    Captures are spread over their keys and meet the intervals by key; at most one interval of an
    entry holds a moment, so a capture gains a row for each entry that applies. Hits alone are
    gathered by capture. The key of a host that holds a third of all captures is a skewed join,
    which adaptive execution splits on the captures' side; a list that is small by its own
    statistics is broadcast by the planner, a larger one is not. A null url or fetch time hits
    nothing; rows that repeat a capture_id each get the categories of all of them.
    """
    active = intervals(events)
    spread = captures.select("capture_id", "fetched", F.explode(keys(F.col("url"))).alias("k")).select("capture_id", "fetched", "k.kind", "k.key")
    hits = spread.join(active, ["kind", "key"]).where("fetched >= valid_from and fetched < valid_to")
    found = hits.groupBy("capture_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    none = F.array().cast("array<string>")
    return captures.select("capture_id", "url", "fetched").join(found, "capture_id", "left").select(
        "capture_id", host(F.col("url")).alias("host"), "fetched", F.coalesce("categories", none).alias("categories"),
        F.coalesce(F.size("categories") > 0, F.lit(False)).alias("blocked"),
    )
