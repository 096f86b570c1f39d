r"""Benchmark decontamination by canonical templates, with DataFrame functions only.

`canonical` lower-cases a text and puts typed placeholders for names (capitalised words inside a sentence),
numbers and the units after them; end punctuation of words is dropped, white space stays, so that the
tokens of a text and of its template correspond one to one.

Every run of WIDTH template tokens of a benchmark item is a window, and so is every run of its unmasked,
lower-cased tokens (of a shorter item the whole of it). Documents' tokens give windows of the same widths; the
hashes of both meet in an equality join, and the tokens of those that meet are compared. Up to
`broadcast_rows` windows (counted first) are broadcast, and no document moves; beyond it, rows of (document,
place, hash) are shuffled, salted by place, and only documents with a match are read again. Either way a long
document costs no more a token than a short one.

Matches of one template at one offset are one alignment, which is held against every item of the template:
tokens met only by unmasked windows must equal the item's. Slots (tokens under a placeholder) must be
consistent, whatever their case: equal item values have equal document values and the other way round. A re-parameterised
question replaces values throughout, unrelated text does not. An alignment counts if its slots are
consistent and the windows cover at least `least_tokens` tokens or the whole item.

Defined cases: null or empty texts match nothing; items of fewer than WIDTH tokens, and windows with fewer
than half literal tokens, are searched unmasked only; items of one template are all reported; repeated rows (same doc_id and text) give
repeated rows; a null doc_id is reported as null; a null item_id sorts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NO_ID, let, packed

WIDTH = 8
#: Salts of the join by shuffle.
PARTS = 16

#: Units of measure that may follow a number; fixed values.
UNITS = "km|m|cm|mm|kg|g|mg|t|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|inch(?:es)?|yards?|pounds?|ounces?|lbs?|oz|dollars?|euros?|cents?|percent|degrees?|metres?|meters?|litres?|liters?|grams?|kilograms?|kilometres?|kilometers?|mph|km/h"

_SPACE = r"[\x20\x09-\x0D]+"


def canonical(text: Column) -> Column:
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:][\x20\x09-\x0D])\p{Lu}[\p{L}\p{M}'’-]*", "<name>")
    numbered = F.regexp_replace(F.lower(named), r"(?<![\p{L}\p{N}])[$€£]?[0-9](?:[0-9.,]*[0-9])?(?:st|nd|rd|th|%)?(?![\p{L}\p{N}])", "<num>")
    united = F.regexp_replace(numbered, rf"(?<=<num>[\x20\x09-\x0D])(?:{UNITS})(?![\p{{L}}\p{{N}}])", "<unit>")
    return F.regexp_replace(united, r"(?<=[\p{L}\p{N}>])[.,;:!?]+(?=[\x20\x09-\x0D]|$)", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda t: t != "")


def is_slot(token: Column) -> Column:
    return token.isin("<name>", "<num>", "<unit>")


def literal(text: Column) -> Column:
    """The text lower-cased and without end punctuation of tokens; nothing is masked, the tokens stay as many."""
    return F.regexp_replace(F.lower(text), r"(?<=[^\x20\x09-\x0D.,;:!?])[.,;:!?]+(?=[\x20\x09-\x0D]|$)", "")


def items_of(items: DataFrame) -> DataFrame:
    """items(item_id, text) -> item_id, canon, inner, lits, tid (of the template), n_item.

    inner is the template as it is behind a lower-case word: there a capitalised first token is masked too.
    """
    text = F.coalesce("text", F.lit(""))
    inner = tokens(canonical(F.concat(F.lit("x "), F.regexp_replace(text, "^" + _SPACE, ""))))
    rows = items.select("item_id", tokens(canonical(text)).alias("canon"), F.slice(inner, F.lit(2), F.size(inner)).alias("inner"), tokens(literal(text)).alias("lits"))
    return rows.where(F.size("canon") > 0).distinct().withColumn("tid", F.xxhash64("canon")).withColumn("n_item", F.size("canon"))


def window_key(lit: Column, ts: Column, at: Column, w: int) -> Column:
    """Hash of the window of w tokens from `at` (from 0) on and of its kind."""
    return F.xxhash64(lit, F.lit(w), *(F.get(ts, at + k) for k in range(w)))


def windows_of(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """items_of -> tid, n_item, ipos, lit, w, match (the tokens to be met), window (their template); both as strings."""
    long = rows.where(F.col("n_item") >= width)
    spans = lambda c, w: F.transform(F.sequence(F.lit(1), F.col("n_item") - w + 1), lambda i: F.slice(c, i, w))
    masked = long.select("tid", "n_item", F.posexplode(spans("canon", F.lit(width))).alias("ipos", "match"))
    first = long.where("inner <> canon").select("tid", "n_item", F.lit(0).alias("ipos"), F.slice("inner", 1, width).alias("match"))
    masked = masked.unionByName(first).distinct().select("*", F.lit(False).alias("lit"), F.col("match").alias("window")).where(F.size(F.filter("match", lambda t: ~is_slot(t))) * 2 >= width)
    # unmasked windows, of a short item the whole of it
    w = F.least(F.lit(width), F.col("n_item"))
    whole = rows.select("tid", "n_item", F.posexplode(F.arrays_zip(spans("lits", w).alias("match"), spans("canon", w).alias("window"))).alias("ipos", "x"))
    whole = whole.select("tid", "n_item", "ipos", "x.match", "x.window").distinct().select("*", F.lit(True).alias("lit"))
    every = masked.unionByName(whole).withColumn("w", F.size("match"))
    key = F.coalesce(*(F.when(F.col("w") == n, window_key(F.col("lit"), F.col("match"), F.lit(0), n)) for n in range(1, width + 1)))
    return every.select("tid", "n_item", "ipos", "lit", "w", F.array_join("match", " ").alias("match"), F.array_join("window", " ").alias("window"), key.alias("wh"))


def _found(rows: DataFrame, windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """rows(key, th, text), windows_of -> key, th, tid, n_item, shift, ipos, lit, window, ours (the document's tokens)."""
    # a short item adds its own width: at most WIDTH of them
    widths = {r.w: r.n for r in windows.groupBy("w").agg(F.count("*").alias("n")).collect()} or {WIDTH: 0}
    split = lambda text: F.split(F.regexp_replace(text, "^" + _SPACE, ""), _SPACE)
    tokens_ = lambda df: df.withColumn("canon", split(canonical(F.col("text")))).withColumn("lits", split(literal(F.col("text")))).drop("text")
    each = tokens_(rows).select("key", "th", "lits", F.inline(F.array(F.struct(F.lit(False).alias("lit"), F.col("canon").alias("ts")), F.struct(F.lit(True).alias("lit"), F.col("lits").alias("ts")))))
    each = each.select("key", "th", "lits", "lit", "ts", F.posexplode("ts").alias("at", "token"))
    at, ts = F.col("at"), F.col("ts")
    keys = [F.struct(F.lit(w).alias("w"), F.when(at + w <= F.size(ts), window_key(F.col("lit"), ts, at, w)).alias("wh")) for w in sorted(widths)]
    key = (lambda df: df.withColumn("w", F.lit(next(iter(widths)))).withColumn("wh", keys[0]["wh"])) if len(keys) == 1 else (lambda df: df.select("*", F.inline(F.array(*keys))))
    each = key(each).where("wh is not null")
    details = windows.drop("lit", "w")
    if sum(widths.values()) <= broadcast_rows:
        hits = each.join(F.broadcast(details), "wh").where(F.array_join(F.slice(ts, at + 1, F.col("w")), " ") == F.col("match")).withColumn("ours", F.slice("lits", at + 1, F.col("w")))
    else:
        salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        salt = F.pmod(F.col("at") + F.col("th"), F.lit(PARTS)).cast("int").alias("salt")
        light = each.select("key", "th", "lit", "w", "at", "wh", salt).join(salted(windows.select("wh").distinct()), ["wh", "salt"])
        # documents with a match are read again; each keeps its number of repeated rows
        light = light.groupBy("key", "th").agg(F.collect_set(F.struct("lit", "w", "at", "wh")).alias("hs"))
        again = tokens_(rows.join(light, ["key", "th"]))
        part = lambda ts, h: F.slice(ts, h["at"] + 1, h["w"])
        found = let(F.col("canon"), lambda cs: let(F.col("lits"), lambda ls: F.transform("hs", lambda h: F.struct(h["lit"].alias("lit"), h["at"].alias("at"), h["wh"].alias("wh"), part(ls, h).alias("ours"), part(F.when(h["lit"], ls).otherwise(cs), h).alias("met")))))
        hits = again.select("key", "th", F.inline(found)).withColumn("salt", salt).join(salted(details), ["wh", "salt"]).where(F.array_join("met", " ") == F.col("match"))
    return hits.select("key", "th", "tid", "n_item", (at - F.col("ipos")).alias("shift"), "ipos", "lit", F.split("window", " ").alias("canon"), "ours")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, least_tokens: int = 12, broadcast_rows: int = 200_000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, th, item_id, n_tokens, n_slots, verbatim; one row per pair found.

    th is xxhash64 of the text: with doc_id it tells rows of the same doc_id apart.
    """
    wanted = items_of(items)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = _found(rows, windows_of(wanted, width), broadcast_rows)
    # one row per place of an alignment; its token under a template (c), under an unmasked window (u), the document's (o)
    alignment = ("key", "th", "tid", "n_item", "shift")
    each = found.select(*alignment, "ipos", "lit", F.posexplode(F.arrays_zip("canon", "ours")).alias("i", "x"))
    first = lambda lit: F.count(F.when((F.col("i") == 0) & (F.col("lit") == lit), 1))
    token = lambda lit: F.min(F.when(F.col("lit") == lit, F.col("x.canon")))
    # a window begins once per row: more often in repeated rows
    places = each.groupBy(*alignment, (F.col("ipos") + F.col("i")).alias("p")).agg(token(False).alias("c"), token(True).alias("u"), F.min("x.ours").alias("o"), F.greatest(first(False), first(True)).alias("copies"))
    aligned = places.groupBy(*alignment).agg(F.array_sort(F.collect_list(F.struct("p", "c", "u", "o"))).alias("met"), F.max("copies").alias("copies"))
    # every item of the template has values of its own; places that only an unmasked window covers must be equal
    aligned = aligned.join(wanted.select("tid", "item_id", "lits", (F.col("inner") != F.col("canon")).alias("named")), "tid")
    aligned = aligned.withColumn("places", F.transform(F.filter("met", lambda x: x.c.isNotNull() | (F.get("lits", x.p) == x.o)), lambda x: F.struct(x.p.alias("p"), F.coalesce(x.c, x.u).alias("c"), x.o.alias("o"))))
    aligned = aligned.withColumn("slots", F.transform(F.filter("places", lambda x: is_slot(x.c)), lambda x: F.struct(x.c.alias("c"), F.get("lits", x.p).alias("t"), x.o.alias("o"))))
    distinct = lambda *f: F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(*(x[k] for k in f)))))
    consistent = (distinct("c", "t") == distinct("c", "t", "o")) & (distinct("c", "o") == distinct("c", "t", "o"))
    n = F.size("places")
    # a capitalised first token is masked or not by what stands before it: it may differ
    whole = (n == F.col("n_item")) | (F.col("named") & (n == F.col("n_item") - 1) & (n >= width) & (F.get("places", F.lit(0)).p == 1))
    good = aligned.where(consistent & ((n >= least_tokens) | whole))
    best = good.groupBy("key", "th", "item_id").agg(F.max(F.struct(n.alias("n"), F.size("slots").alias("s"), F.forall("slots", lambda x: x.t == x.o).alias("v"))).alias("m"), F.max("copies").alias("copies"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return best.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "th", "item_id", F.col("m.n").cast("long").alias("n_tokens"), F.col("m.s").cast("long").alias("n_slots"), F.col("m.v").alias("verbatim"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found."""
    hits = matches(docs, items).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "th").distinct()
    rows = packed(docs).select("rest", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    left = rows.join(hits, ["key", "th"], "left_anti")
    return left.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
