"""Near-duplicate documents by bottom-k sketches.

A document's set is its distinct five-word shingles (words: runs of anything but ASCII white space, A-Z
lower-cased); one hash function orders the shingles, and the k smallest values form the sketch.

1. Documents with equal sets fall together at once, through a 128-bit digest of the sorted set.
2. Two sets with Jaccard 0.75 share about three quarters of the k smallest values of their union, so two
   sketches of a link share at least `least` values but for a chance of about 1 in 1,000,000,000. Hence each
   sketch needs inverted-list entries only for its k - least + 1 rarest values: a passage that many
   documents share has frequent values, which stay out of the lists. (Of sets small enough
   that every partner's sketch is its whole set, a link shares three quarters for certain.)
3. In each inverted list one pivot, the document with the most frequent values (the original of a group of
   copies), is compared with the whole list: the Jaccard estimate over the union's sketch filters, the exact
   Jaccard of the full sets confirms. Linked documents get one label; lists of one label are done.
4. Documents of the other lists get lists by their full sets. In the order of frequency, rarest first, two
   sets of sizes m and n that are linked share ceil(3/7 (m + n)) shingles, so one within the first
   m - that + 1 of the one and the first n - that + 1 of the other. Copies that differ too much have too
   many shingles of their own and meet nobody.
5. In those lists pivots, sixteen times as many each turn, are compared with the list as in 3, until no list
   has two labels and an uncompared pair. A list of n near copies thus costs n pairs and not n * n, and no
   pair of different labels that could be linked is skipped.

Skew: a value that a third of all sketches or sets hold is found by counting, and the rows of its list are
dealt to salts; the other side of such a join (counts, pivots) is repeated once per salt. So are the rows of a
large group of equal sets.

Defined cases: null, empty or wordless text has the empty set and is linked with nothing; fewer than five
words form one shingle; a null doc_id has component_id null and is kept; repeated rows give repeated
result rows. Rows with one doc_id and different texts are one document, which the text of the smallest set
digest stands for: they all get its component. Only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WordHashes, binary_rows, keyed, map_batches, smallest_labels, window_hashes
from lexmill.operators.joins import Hot, hot_keys, salted_join
from lexmill.sources.shared import park

WIDTH = 5
SKETCH = 64
#: Of 64 values 48 are shared on average at Jaccard 0.75; fewer than 26 with a chance of 1.3e-9 (binomial).
LEAST_SHARE = 0.40625


def shingle_set(text: bytes, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as signed numbers: the order of a sketch is the one Spark sorts longs by."""
    words = hashes.of(text.lower().split())
    return np.unique(window_hashes(words, min(width, max(1, len(words)))).view(np.int64))


def _sketches(k: int):
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, sketches = [], [], []
        for text in binary_rows(batch, "text"):
            s = shingle_set(text, hashes)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(s[:k])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch"])

    return run


def _full_sets():
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(text, hashes) for text in binary_rows(batch, "text")]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "digest", "full"])

    return run


def estimate(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Share of the k smallest values of the union that both sets hold; the sketches, the first k of each, tell."""
    x, y = x[:k], y[:k]
    values, times = np.unique(np.concatenate((x, y)), return_counts=True)
    return float((times[:k] == 2).mean())


def _verify(percent: int, k: int):
    """Pairs whose sketches agree enough and whose full sets are linked."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("full_a"), batch.column("full_b"), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            linked = estimate(x, y, k) >= LEAST_SHARE
            if linked:
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked = 100 * both >= percent * (len(x) + len(y) - both)
            keep.append(linked)
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _exact_lists(entries: DataFrame, full: DataFrame, percent: int) -> tuple[Hot, DataFrame]:
    """Inverted lists of the full sets of the documents in the entries: the hot lists, and v, id, o, n, pos (from 0, rarest first), label, _salt."""
    docs = entries.select("id", "o", "n", "label").distinct()
    values = docs.join(full, "id").select("id", F.explode("full").alias("v"))
    shared = park(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "near-full-counts")
    hot = hot_keys(shared, "v", "df")
    met = hot.dealt(values, "id").join(hot.repeated(shared), ["v", "_salt"])
    ranked = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs")).join(docs, "id")
    # shingles that no other of these documents has come before all others
    own = F.col("n") - F.size("vs")
    places = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own).cast("int")
    each = ranked.select("id", "o", "n", "label", own.alias("own"), F.posexplode(F.slice("vs", F.lit(1), F.greatest(F.lit(0), places))).alias("at", "e"))
    return hot, hot.dealt(each.select(F.col("e.v").alias("v"), "id", "o", "n", (F.col("own") + F.col("at")).alias("pos"), "label"), "id")


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = SKETCH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    docs = keyed(docs)
    sketched = park(map_batches(docs, _sketches(k), "doc_id long, n_shingles long, digest binary, sketch array<long>"), "near-sketches")
    # one text stands for a doc_id (there are few with several), one document for all with the same set
    chosen = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("chosen"), F.max("digest").alias("other")).where("chosen <> other")
    chosen = park(chosen.select("doc_id", "chosen"), "near-chosen")
    several = not chosen.isEmpty()
    sketched = sketched.join(chosen, "doc_id", "left") if several else sketched.withColumn("chosen", F.lit(None).cast("binary"))
    usable = sketched.where("digest is not null and doc_id is not null and (chosen is null or chosen = digest)")
    sets = park(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "near-sets")

    values = sets.select("id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    shared = park(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "near-counts")
    # a value that many sketches hold may make a long list
    hot = hot_keys(shared, "v", "df")
    ranked = hot.dealt(values, "id").join(hot.repeated(shared), ["v", "_salt"]).groupBy("id").agg(F.first("s").alias("s"), F.first("n").alias("n"), (-F.sum("df")).alias("hub"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # values that only this sketch holds are its rarest: they use up the first places of the prefix
    least = F.ceil(F.col("s") * F.when(F.col("s") <= k * percent / 100, percent / 100).otherwise(LEAST_SHARE))
    places = (F.size("vs") - least + 1).cast("int")
    ranked = ranked.select("id", F.struct("hub", "id").alias("o"), "n", F.explode(F.slice("vs", F.lit(1), F.greatest(F.lit(0), places))).alias("e"))
    lists = park(ranked.select("id", "o", "n", F.col("e.v").alias("v")), "near-lists")

    members = lists.select("id").distinct()
    wanted = docs.join(members, docs.doc_id == members.id, "left_semi")
    full = map_batches((wanted.join(chosen, "doc_id", "left_anti") if several else wanted).dropDuplicates(["doc_id"]), _full_sets(), "id long, digest binary, full array<long>")
    if several:
        again = map_batches(wanted.join(chosen, "doc_id", "left_semi"), _full_sets(), "id long, digest binary, full array<long>")
        full = full.unionByName(again.join(chosen.select(F.col("doc_id").alias("id"), F.col("chosen").alias("digest")), ["id", "digest"], "left_semi").dropDuplicates(["id"]))
    full = park(full.drop("digest"), "near-full")

    labels, pivots, exact = None, 1, False
    entries = hot.dealt(lists.withColumn("label", F.col("id")).withColumn("pos", F.lit(0)), "id")
    # the shingles that linked sets share: J / (1 + J) of the sum of their sizes, at least
    overlap = lambda m, n: f"ceil({percent} * ({m} + {n}) / {100 + percent})"
    while True:
        open_lists = entries.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
        entries = park(entries.join(hot.repeated(open_lists), ["v", "_salt"], "left_semi"), "near-open")
        if entries.isEmpty():
            break
        if pivots > 1 and not exact:
            exact = True
            hot, entries = _exact_lists(entries, full, percent)
            entries = park(entries, "near-exact")
            continue
        first = entries.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("o"))).where(F.col("rank") <= pivots)
        first = park(first.select("v", F.col("id").alias("a"), F.col("o").alias("o_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("label").alias("label_a")), "near-pivots")
        within = f"pos <= n - {overlap('n_a', 'n')} and pos_a <= n_a - {overlap('n_a', 'n')}" if exact else "true"
        pairs = hot.repeated(first).join(entries, ["v", "_salt"]).where(f"o_a < o and label_a <> label and 100 * least(n_a, n) >= {percent} * greatest(n_a, n) and {within}")
        pairs = pairs.select("a", F.col("id").alias("b")).distinct()
        # a set's sketch is its beginning, so the sets alone travel; a pivot with very many partners is split by the adaptive skew join
        of = lambda side: full.select(F.col("id").alias(side), F.col("full").alias(f"full_{side}"))
        met = pairs.join(of("a"), "a").join(of("b"), "b")
        links = park(map_batches(met.select("a", "b", "full_a", "full_b"), _verify(percent, k), "a long, b long"), "near-links")
        if labels is not None:
            links = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
            links = links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        links = links.where("a <> b")
        if not links.isEmpty():
            new = smallest_labels(links, "near")
            if labels is None:
                labels = new
            else:
                moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                labels = park(moved.unionByName(new.join(labels.select("node"), "node", "left_anti")), "near-labels")
        cut = first.groupBy("v").agg(F.max("o_a").alias("cut"))
        entries = entries.join(hot.repeated(cut), ["v", "_salt"]).where("o > cut").drop("cut", "label")
        if labels is None:
            entries = entries.withColumn("label", F.col("id"))
        else:
            entries = entries.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        pivots *= 16

    label = sets.select("digest", "id", "copies")
    if labels is not None:
        label = label.join(labels.withColumnRenamed("node", "id"), "id", "left").select("digest", "copies", F.coalesce("label", "id").alias("label"))
    else:
        label = label.withColumnRenamed("id", "label")
    own = sketched.select("doc_id", "n_shingles", F.coalesce("chosen", "digest").alias("digest"))
    out = salted_join(own, label, "digest", "doc_id", "left", counted="copies")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
