"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, `passes` times over. Its virtual clock runs at
its target: a packet's finish time is the number of words of its source up to and with it, divided by the
source's target. Packets of all queues are put into the order of their finish times, and the mix ends where
its words reach the total budget. Documents of more than `packet` words are queued as several packets, as
long frames are, so that the end of the mix is at most a packet from each target.

Targets: sources take the weights in turn in the order of code points (null last) and share `share` of all
words; a target stops at `passes` times its source's words and the excess goes to the others by weight.

Scale: words of a source before a document, and of the mix before a packet, are running totals over buckets
(`with_running_total`): hash ranges of a source, or equal ranges of virtual time, over which packets spread
evenly since documents are shuffled. Bucket sums are added up first, so a source with a third of all rows is
dealt over as many tasks as its rows ask for, and no order is ever made in one task. Documents are shuffled
as (doc_id, source, size) only.

Defined cases: null text has no words, and a document without words is never taken; rows without a source are
one source; rows without a doc_id count as others do; rows alike in doc_id, source and size are told apart by
number and may swap their shares, so reruns agree; an empty table gives an empty result; columns besides
doc_id, text and source are not read. At most MOST_SOURCES sources: their table alone, a row each, passes
one task; with more, the operator raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.joins import salted_join
from lexmill.sources.shared import park

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a bucket, buckets in a group of buckets, and bits of a shuffle key.
BUCKET, GROUP, KEY_BITS = 4_096, 4_096, 60
MOST_SOURCES, FEW_SOURCES = 1_000_000, 10_000


def with_running_total(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` up to and with a row in (bucket, order), within each group. `rows` is read twice.

    Bucket sums are added up in two levels; only rows of one bucket meet in a task.
    """
    level = F.floor(F.col(bucket) / GROUP).alias("_level")
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum")).select("*", level)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    levels = sums.groupBy(*group, "_level").agg(F.sum("_sum").alias("_all"))
    levels = levels.select(*group, "_level", F.coalesce(F.sum("_all").over(before(*group).orderBy("_level")), F.lit(0)).alias("_below"))
    starts = sums.join(levels, [*group, "_level"]).select(*group, bucket, (F.col("_below") + F.coalesce(F.sum("_sum").over(before(*group, "_level").orderBy(bucket)), F.lit(0))).alias("_start"))
    own = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, [*group, bucket]).withColumn(out, F.col("_start") + F.sum(value).over(own)).drop("_start")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """sources(host, source_size, ...) with `target`.

    Sources fill up together at the speed of their weights until the words shared are used up; one that is full
    leaves. The full ones come first in the order of size / weight: a source is full if filling all to its level costs
    no more than there is to share.
    """
    place = F.row_number().over(Window.orderBy("host")) - 1
    weighed = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy(F.col("source_size") / F.col("_w"), "host").rowsBetween(Window.unboundedPreceding, 0)
    known = weighed.select("*", F.sum("source_size").over(rising).alias("_filled"), (F.sum("_w").over(everything) - F.sum("_w").over(rising)).alias("_rest"), (F.sum("source_size").over(everything) * F.lit(share)).alias("_budget"))
    full = (passes * F.col("_filled") * F.col("_w") + passes * F.col("source_size") * F.col("_rest")).cast("double") <= F.col("_budget") * F.col("_w")
    known = known.withColumn("_full", full)
    left = F.col("_budget") - passes * F.sum(F.when(F.col("_full"), F.col("source_size")).otherwise(0)).over(everything)
    open_weights = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), (passes * F.col("source_size")).cast("double")).otherwise(F.col("_w") * left / open_weights)
    return known.withColumn("target", target).drop("_w", "_filled", "_rest", "_budget", "_full")


def _shuffle_key(seed: int) -> Column:
    """A number under 2^KEY_BITS of the document: the first 15 digits of an MD5."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("nth").cast("string"))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def queued(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, host, size, nth (among rows alike), source_size, target, upto: words of its source up to and with the document."""
    # a name that sorts as the source does, null last
    host = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("host")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size")
    alike = park(docs.select(F.col("doc_id").cast("long").alias("doc_id"), host, size).groupBy("doc_id", "host", "size").agg(F.count("*").alias("times")), "mixing-sizes")
    sources = alike.groupBy("host").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n_docs"))
    n_sources = sources.count()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources; a mix takes {MOST_SOURCES} at most")
    known = targets(sources, weights, share, passes)
    rows = alike.withColumn("_spread", F.xxhash64("doc_id", "size"))
    rows = rows.join(F.broadcast(known), "host") if n_sources <= FEW_SOURCES else salted_join(rows, known, "host", "_spread", counted="n_docs")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).withColumn("key", _shuffle_key(seed))
    width = F.ceil(F.lit(1 << KEY_BITS) / F.ceil(F.col("n_docs") / BUCKET))
    rows = rows.select("doc_id", "host", "size", "nth", "source_size", "target", "key", F.floor(F.col("key") / width).alias("range"))
    return park(with_running_total(rows, ["host"], "range", ["key", "doc_id", "size", "nth"], "size", "upto").drop("range", "key"), "mixing-queues")


def packets(queue: DataFrame, share: float = 1.5, passes: int = 2, packet: int = 256) -> DataFrame:
    """The packets of all queues: doc_id, host, size, nth, source_size, target, turn (which pass), part, words, finish, total (words of the mix up to
    and with the packet, in the order of finish times), taken (whether the mix has it)."""
    n_words, n_packets = queue.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("size") / packet)), F.lit(0))).first()
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / packet), F.lit(1)).cast("int") - 1)
    turns = queue.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("turn"))
    rows = turns.select("*", F.explode(parts).alias("part")).withColumn("words", F.least(F.lit(packet), F.col("size") - packet * F.col("part")))
    done = F.col("turn") * F.col("source_size") + F.col("upto") - F.col("size") + packet * F.col("part") + F.col("words")
    rows = rows.withColumn("finish", done / F.col("target")).drop("upto")
    # all targets are reached at time 1; the packets up to then are spread evenly
    span = max(1, -(-n_packets * passes // BUCKET))
    rows = rows.select("*", F.floor(F.col("finish") * span).alias("span"), F.lit(0).alias("_mix"))
    ordered = with_running_total(rows, ["_mix"], "span", ["finish", "host", "turn", "part"], "words", "total")
    return ordered.drop("_mix", "span").withColumn("taken", F.col("total") <= F.lit(n_words * share))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, packet: int = 256, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken (words, repeats counted), first (place of its first word in the mix; null if none is taken)."""
    queue = queued(docs, weights, share, passes, seed)
    row = ["doc_id", "host", "size", "nth", "source_size", "target"]
    mix = packets(queue, share, passes, packet)
    words = F.sum(F.when(F.col("taken"), F.col("words")).otherwise(0)).cast("long")
    found = mix.groupBy(*row).agg(words.alias("taken"), F.min(F.when(F.col("taken"), F.col("total") - F.col("words"))).alias("first"))
    empty = queue.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first"))
    source = F.when(F.col("host") != "1", F.substring("host", 2, (1 << 31) - 1)).alias("source")
    return found.unionByName(empty).select("doc_id", source, "size", "source_size", "target", "taken", "first")
