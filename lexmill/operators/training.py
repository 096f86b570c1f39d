"""Count models: vocabulary, transitions, case, endings, tag maps. Aggregations only; partial counts precede each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators.tokens import SENTENCE, in_sentence

ENTRY = ("form", "lemma", "upos", "xpos", "feats")


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(*ENTRY).agg(F.count("*").alias("cnt"))


def transitions(tokens: DataFrame, tag: str = "upos", starts: bool = True) -> DataFrame:
    """prev, tag, cnt; at a sentence's start prev is START (left out without `starts`)."""
    pairs = tokens.select(F.lag(tag).over(in_sentence()).alias("prev"), F.col(tag).alias("tag"))
    pairs = pairs.withColumn("prev", F.coalesce("prev", F.lit("START"))) if starts else pairs.where("prev is not null")
    return pairs.groupBy("prev", "tag").agg(F.count("*").alias("cnt"))


def case_profile(tokens: DataFrame, tag: str = "upos") -> DataFrame:
    return tokens.groupBy(F.col(tag).alias("tag"), t.case_class(F.col("form")).alias("wcase")).agg(F.count("*").alias("cnt"))


def case_profile_of(vocab: DataFrame, tag: str = "upos") -> DataFrame:
    """The same, from counted entries."""
    return vocab.groupBy(F.col(tag).alias("tag"), t.case_class(F.col("form")).alias("wcase")).agg(F.sum("cnt").alias("cnt"))


def vocabulary_stats(tokens: DataFrame) -> DataFrame:
    entries = vocabulary(tokens).agg(F.count("*").alias("entries"), F.sum("cnt").alias("tokens"))
    words = tokens.select("form").distinct().agg(F.count("*").alias("words"))
    sentences = tokens.select(*SENTENCE).distinct().agg(F.count("*").alias("sentences"))
    # three single rows
    return entries.crossJoin(words).crossJoin(sentences)


def affixes(form: Column, length: int) -> Column:
    """Endings of 1 to `length` code points; beginnings if `length` is negative."""
    longest = F.least(F.length(form), F.lit(abs(length)))
    cut = (lambda n: F.substring(form, F.lit(1), n)) if length < 0 else (lambda n: F.substring(form, F.length(form) - n + 1, n))
    return F.when(longest > 0, F.transform(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), cut))


def endings(vocab: DataFrame, tag: str = "upos", length: int = 6) -> DataFrame:
    """ending, tag, types: how many different entries with that tag end so."""
    entries = vocab.select("form", "lemma", F.col(tag).alias("tag")).distinct()
    return entries.select("tag", F.explode(affixes(F.col("form"), length)).alias("ending")).groupBy("ending", "tag").agg(F.count("*").alias("types"))


def ending_rules(vocab: DataFrame, rule: Column, tag: str = "upos", length: int = 6) -> DataFrame:
    """ending, tag, rule, cnt: lemma rules seen with an ending; rule is an expression over form and lemma."""
    entries = vocab.select("form", "lemma", F.col(tag).alias("tag")).distinct().withColumn("rule", rule).where("rule is not null")
    return entries.select("tag", "rule", F.explode(affixes(F.col("form"), length)).alias("ending")).groupBy("ending", "tag", "rule").agg(F.count("*").alias("cnt"))


def best_rule(rules: DataFrame) -> DataFrame:
    """The most frequent rule of each (ending, tag), of equal ones the first in the alphabet."""
    w = Window.partitionBy("ending", "tag").orderBy(F.desc("cnt"), "rule")
    return rules.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def tag_types(tokens: DataFrame, tag: str = "upos") -> DataFrame:
    return tokens.select(F.col(tag).alias("tag"), "form").distinct().groupBy("tag").agg(F.count("*").alias("types"))


def top_entries(vocab: DataFrame, tag: str = "upos") -> DataFrame:
    """The most frequent entry of each tag, of equal ones the first by form, lemma, xpos, feats."""
    w = Window.partitionBy(tag).orderBy(F.desc("cnt"), "form", "lemma", "xpos", "feats")
    return vocab.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(F.col(tag).alias("tag"), "form", "lemma", "cnt")


def mwt_counts(mwts: DataFrame) -> DataFrame:
    """form, parts, cnt of multiword tokens(form, parts array<string>)."""
    return mwts.groupBy("form", F.array_join("parts", "+").alias("parts")).agg(F.count("*").alias("cnt"))


def best_split(words: DataFrame, mwts: DataFrame) -> DataFrame:
    """words(form) with the most frequent parts of that form, null without one."""
    w = Window.partitionBy("form").orderBy(F.desc("cnt"), "parts")
    best = mwts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("form", "parts")
    return words.join(best, "form", "left")


# --- maps between tagsets -------------------------------------------------------------------------------------


def tag_map(tokens: DataFrame) -> DataFrame:
    """xpos -> its most frequent (upos, feats), ties by name."""
    counts = tokens.groupBy("xpos", "upos", "feats").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("xpos").orderBy(F.desc("cnt"), "upos", "feats")
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("xpos", "upos", "feats", "cnt")


def map_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """tags(xpos) with upos, feats, how: exact, else by lower case, else without a suffix of digits and marks.

    Of tags that differ in case alone the most frequent counts. The map is small by its nature (a tagset); each
    step is a hash join on the rows left over, by coalesce.
    """
    first = lambda key: mapping.withColumn("key", key).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cnt"), "xpos"))).where("rank = 1").select("key", "upos", "feats")
    bare = F.regexp_replace("xpos", r"[0-9.\-_:]+$", "")
    steps = [("exact", F.col("xpos"), F.col("xpos")), ("case", F.lower("xpos"), F.lower("xpos")), ("bare", bare, F.col("xpos"))]
    out = tags
    for name, own, theirs in steps:
        side = first(theirs).select(F.col("key").alias(f"key_{name}"), F.struct("upos", "feats", F.lit(name).alias("how")).alias(f"hit_{name}"))
        out = out.join(side, own == F.col(f"key_{name}"), "left").drop(f"key_{name}")
    hit = F.coalesce(*(f"hit_{name}" for name, _, _ in steps))
    return out.withColumn("hit", hit).select(*tags.columns, "hit.upos", "hit.feats", F.coalesce("hit.how", F.lit("none")).alias("how"))


def reverse_tag_map(tokens: DataFrame) -> DataFrame:
    """(upos, feats) -> its most frequent xpos, ties by name."""
    counts = tokens.groupBy("upos", "feats", "xpos").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("upos", "feats").orderBy(F.desc("cnt"), "xpos")
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("upos", "feats", "xpos", "cnt")


def guess_xpos(wanted: DataFrame, tokens: DataFrame) -> DataFrame:
    """wanted(upos, feats) with the most frequent xpos of that reading, else of a reading that has all wanted features (and more)."""
    r = reverse_tag_map(tokens).select(F.col("upos").alias("upos_r"), F.col("feats").alias("feats_r"), "xpos", "cnt")
    pairs = wanted.join(r, (wanted.upos == r.upos_r) & t.feats_within(wanted.feats, F.col("feats_r")))
    exact = F.col("feats_r") == F.col("feats")
    w = Window.partitionBy("upos", "feats").orderBy(exact.desc(), F.desc("cnt"), "xpos")
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("upos", "feats", "xpos", exact.alias("exact"))


def with_mapped_tags(tokens: DataFrame, model: DataFrame, direction: str = "both") -> DataFrame:
    """tokens with what is missing filled in from a model's tokens: `upos-feats` from xpos, `xpos` from upos and feats, or `both`.

    Different tags are few: each is mapped once, and tokens meet the maps in broadcast joins of the size of two tagsets.
    """
    if direction not in ("xpos", "upos-feats", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    missing = lambda c: F.coalesce(F.col(c), F.lit("_")).isin("_", "")
    out = tokens
    if direction != "xpos":
        found = map_tags(tokens.where(~missing("xpos")).select("xpos").distinct(), tag_map(model.where(~missing("xpos"))))
        found = found.select("xpos", F.col("upos").alias("_upos"), F.col("feats").alias("_feats")).where("_upos is not null")
        out = out.join(F.broadcast(found), "xpos", "left")
        out = out.withColumn("upos", F.when(missing("upos"), F.coalesce("_upos", "upos")).otherwise(F.col("upos"))).withColumn("feats", F.when(missing("feats"), F.coalesce("_feats", "feats")).otherwise(F.col("feats"))).drop("_upos", "_feats")
    if direction != "upos-feats":
        blank = out.where(missing("xpos")).select(F.coalesce("upos", F.lit("_")).alias("upos"), F.coalesce("feats", F.lit("_")).alias("feats")).distinct()
        found = guess_xpos(blank, model).select(F.col("upos").alias("_upos"), F.col("feats").alias("_feats"), F.col("xpos").alias("_xpos"))
        out = out.join(F.broadcast(found), (F.coalesce(out.upos, F.lit("_")) == F.col("_upos")) & (F.coalesce(out.feats, F.lit("_")) == F.col("_feats")), "left")
        out = out.withColumn("xpos", F.when(missing("xpos"), F.coalesce("_xpos", "xpos")).otherwise(F.col("xpos"))).drop("_upos", "_feats", "_xpos")
    return out.select(*tokens.columns)


# --- inventories ----------------------------------------------------------------------------------------------


def ud_inventory(tokens: DataFrame) -> DataFrame:
    """field, name, value, cnt over UPOS and FEATS."""
    upos = tokens.select(F.lit("UPOS").alias("field"), F.lit("").alias("name"), F.col("upos").alias("value"))
    pair = F.explode(F.filter(F.split("feats", r"\|"), lambda x: x.contains("=")))
    feats = tokens.select(pair.alias("pair")).select(F.lit("FEATS").alias("field"), F.substring_index("pair", "=", 1).alias("name"), F.regexp_replace("pair", "^[^=]*=", "").alias("value"))
    return upos.unionByName(feats).groupBy("field", "name", "value").agg(F.count("*").alias("cnt"))


#: Comments that belong to a sentence; fixed values. Others may belong to the document as well.
SENTENCE_FIELDS = ("sent_id", "text", "lang", "date", "speaker", "participant", "annotator", "translation", "align", "translation_lang", "corr")


def field_inventory(lines: DataFrame, line: str = "line") -> DataFrame:
    """field (MISC, DOC or SENT), name, cnt over lines of CoNLL-U: fields of MISC, attributes of newdoc, names of comments.

    A comment NAME = VALUE is of the sentence, and of the document too unless its name is one of SENTENCE_FIELDS.
    """
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    named = lambda kind, raw: F.struct(F.lit(kind).alias("field"), raw.alias("raw"))
    before = lambda pairs: F.transform(F.filter(pairs, lambda x: x.contains("=")), lambda x: F.trim(F.substring_index(x, "=", 1)))
    columns = F.split("text", "\t")
    misc = F.transform(before(F.split(F.get(columns, F.lit(9)), r"\|")), lambda x: named("MISC", x))
    attributes = F.transform(before(F.split("text", r"\s+")), lambda x: named("DOC", x))
    comment = F.regexp_extract("text", r"^#\s*([^=]+?)\s*=\s*.", 1)
    comments = F.array(named("SENT", comment), named("COMMENT", comment))
    found = F.when(F.col("text").startswith("# newdoc"), attributes).when(F.col("text").startswith("# newpar"), None).when(F.col("text").startswith("#"), comments).when(F.size(columns) >= 10, misc)
    rows = lines.select(text.alias("text")).select(F.inline(found))
    clean = t.misc_name(F.col("raw"))
    rows = rows.withColumn("name", F.when(F.col("field") == "MISC", clean).otherwise(F.coalesce(clean, "raw"))).where("name <> ''")
    rows = rows.where((F.col("field") != "COMMENT") | ~F.col("name").isin(*SENTENCE_FIELDS))
    return rows.groupBy(F.when(F.col("field") == "COMMENT", "DOC").otherwise(F.col("field")).alias("field"), "name").agg(F.count("*").alias("cnt"))


#: The universal part-of-speech tags; fixed values.
UPOS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")


def extended_upos(tags: DataFrame) -> DataFrame:
    """Tags of a column `upos` outside the universal ones."""
    # different tags are few; tokens are counted out before anything moves
    return tags.select("upos").distinct().where(F.col("upos").isNull() | ~F.col("upos").isin(*UPOS))


# --- spelling -------------------------------------------------------------------------------------------------


def dominant_reg(pairs: DataFrame) -> DataFrame:
    """pairs(form, reg; reg null or _ if unchanged) -> form, reg, cnt: the regular form that dominates.

    It must outnumber the unchanged uses, or these must be under a fifth of all.
    """
    changed = ~F.coalesce(F.col("reg"), F.lit("_")).isin("_", "") & (F.col("reg") != F.col("form"))
    counts = pairs.groupBy("form", F.when(changed, F.col("reg")).alias("reg")).agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("form")
    counts = counts.withColumn("all", F.sum("cnt").over(w)).withColumn("same", F.coalesce(F.sum(F.when(F.col("reg").isNull(), F.col("cnt"))).over(w), F.lit(0)))
    best = counts.where("reg is not null").withColumn("rank", F.row_number().over(w.orderBy(F.desc("cnt"), "reg"))).where("rank = 1")
    return best.where((F.col("cnt") > F.col("same")) | (F.col("same") * 5 < F.col("all"))).select("form", "reg", "cnt")


def suffix_patterns(pairs: DataFrame, longest: int = 4, least: int = 5) -> DataFrame:
    """suffixes of 1 to `longest` that words share with their regular forms while the stems differ, if frequent."""
    rows = pairs.where("form <> reg").select("form", "reg", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"))
    rows = rows.where("length(form) > n and length(reg) > n and right(form, n) = right(reg, n)")
    return rows.groupBy(F.expr("right(form, n)").alias("suffix")).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def substitutions(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Single-character replacements between words and regular forms of the same length, if frequent."""
    rows = pairs.where("form <> reg and length(form) = length(reg)")
    zipped = F.arrays_zip(F.split("form", "").alias("a"), F.split("reg", "").alias("b"))
    each = rows.select(F.explode(F.filter(zipped, lambda x: x["a"] != x["b"])).alias("x"))
    return each.groupBy(F.col("x.a").alias("old"), F.col("x.b").alias("new")).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
