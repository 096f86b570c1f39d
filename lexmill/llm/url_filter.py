"""URL filters with dated lists.

A list is a log of entries (kind, key, action, at): from `at` on, the key of that kind is listed (`add`) or
not (`remove`). Kinds: `domain` (the host or any of its parents), `url` (host and path, any longer path
included at a `/`). Sorted by date within (kind, key), the log becomes validity intervals [at, next at); of
entries with the same instant the removal holds.

A capture (id, url, fetched) looks up the host and its parents and the path prefixes, and is blocked if an
entry was active at its fetch time. The as-of join is an equality join on (kind, key, month): an interval is
stored once per month it covers, so a key with a long history spreads over its months and a capture meets
the few intervals of one month; of these at most one per key holds its instant.

Skew: a host may have a third of all captures. Up to `broadcast_rows` interval rows (counted first) the
intervals are broadcast and no capture moves; beyond it both sides are hashed with a salt drawn from the
capture's row, the interval rows copied to each salt.

Defined cases: a null or hostless url, or a null fetch time, matches nothing and passes; entries with a
null part are ignored; intervals without end last until the last month of the captures; repeated captures
give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import park

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """array<struct<kind, key>> of everything a list entry could name."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    steps = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    paths = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(F.lit("url").alias("kind"), F.concat_ws("/", F.array(host), F.slice(steps, F.lit(1), i)).alias("key")))
    return F.when(host != "", F.array_distinct(F.concat(parents, F.slice(paths, F.lit(2), F.size(paths))))).otherwise(F.expr("array()"))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, since, until (null: still listed) of the times a key is listed."""
    clean = entries.select("kind", "key", "action", "at").dropna().where(F.col("action").isin("add", "remove"))
    one = clean.groupBy("kind", "key", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("kind", "key").orderBy("at")
    return one.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select("kind", "key", F.col("at").alias("since"), "until")


def as_of_filter(captures: DataFrame, entries: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """captures(id, url, fetched) -> id, blocked, n_active, since (of the latest entry in force)."""
    rows = park(captures.select("id", "url", "fetched").withColumn("row", F.monotonically_increasing_id()), "url-captures")
    month = lambda c: F.trunc(c, "month")
    ends = rows.agg(month(F.max("fetched")).alias("last"))
    listed = intervals(entries).crossJoin(F.broadcast(ends)).withColumn("end", F.least(month(F.coalesce("until", "last")), F.col("last")))
    listed = listed.where(month(F.col("since")) <= F.col("end"))
    listed = park(listed.select("kind", "key", "since", "until", F.explode(F.expr("sequence(trunc(since, 'month'), end, interval 1 month)")).alias("month")), "url-list")

    looked = rows.where("fetched is not null").select("row", "fetched", month(F.col("fetched")).alias("month"), F.inline(keys_of(F.col("url"))))
    keys = ["kind", "key", "month"]
    if listed.count() <= broadcast_rows:
        met = looked.join(F.broadcast(listed), keys)
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = looked.withColumn("salt", (F.col("row") % SALTS).cast("int")).join(salted, [*keys, "salt"])
    met = met.where("since <= fetched and (until is null or fetched < until)")
    hits = met.groupBy("row").agg(F.count("*").alias("n"), F.max("since").alias("since"))
    return rows.join(hits, "row", "left").select("id", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).alias("n_active"), "since")
