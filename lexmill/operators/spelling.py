r"""Dictionaries of stems and affix rules, lookup, and the nearest forms of unknown words.

An affix file has lines  KIND FLAG CROSS COUNT  (a header) and  KIND FLAG STRIP ADD[/FLAGS] CONDITION, where KIND
is PFX or SFX and 0 stands for nothing; a word file has lines  WORD[/FLAGS]. Rules become a table; `expanded` joins stems
with the rules of their flags: a suffix, one more by the flags that a suffix carries, and a prefix on stems and on suffixed forms
where both rules may cross. A rule takes a word that ends (begins) as its condition says and is longer than what it strips.

`suggestions` finds every form within `edits` (insertions, deletions, substitutions) of a word: of both, the first PREFIX
characters with up to `edits` characters deleted are keys of an equality join, then the distance is taken. No form within that
distance is lost: of two such words, the first PREFIX characters have a common subsequence that lacks at most `edits` of either.
A word has a bounded number of keys, however long it is.

Defined cases: null and empty words are neither known nor corrected; repeated stems have the flags of all; a flag without rules adds
nothing; lines of other kinds are passed over (FLAG, NEEDAFFIX and FORBIDDENWORD are heeded, compounds and REP aren't).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.joins import salted_join
from lexmill.sources.shared import park

#: Leading characters whose deletions are keys.
PREFIX = 12
#: Rules that are broadcast; more of them are joined by shuffle.
FEW = 100_000

#: Column of a rule's flags: one character each, two each, or numbers between commas; fixed values of the format.
_FLAGS = {"": r"(?s).", "long": r"(?s)..", "num": r"[0-9]+", "UTF-8": r"(?s)."}


def _flags(text: Column, kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FLAGS[kind]), F.lit(0)))


def directives(spark: SparkSession, path: str) -> dict[str, str]:
    """FLAG, NEEDAFFIX and FORBIDDENWORD of an affix file, those it has."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(fields, F.lit(0)).alias("k"), F.get(fields, F.lit(1)).alias("v"))
    return {r.k: r.v for r in rows.where(F.col("k").isin("FLAG", "NEEDAFFIX", "FORBIDDENWORD")).groupBy("k").agg(F.max("v").alias("v")).collect()}


def read_affixes(spark: SparkSession, path: str) -> DataFrame:
    """kind, flag, crosses, strip, add, more (flags the affixed form has), condition (a pattern), of an affix file."""
    kind = directives(spark, path).get("FLAG", "")
    f = F.split(F.trim(F.regexp_replace("value", "^﻿", "")), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where(F.get("f", F.lit(0)).isin("PFX", "SFX") & (F.size("f") >= 4))
    at = lambda k: F.get("f", F.lit(k))
    header = (F.size("f") == 4) & at(2).isin("Y", "N") & at(3).rlike("^[0-9]+$")
    heads = rows.where(header).select(at(0).alias("kind"), at(1).alias("flag"), at(2).alias("y")).groupBy("kind", "flag").agg((F.max("y") == "Y").alias("crosses"))
    nothing = lambda c: F.when(c == "0", "").otherwise(c)
    add = F.split(at(3), "/", 2)
    # between brackets a hyphen is itself, and nothing but brackets, the dot and the caret is special
    condition = F.regexp_replace(F.coalesce(at(4), F.lit(".")), r"([\\$|?*+(){}&-])", r"\\$1")
    rules = rows.where(~header).select(at(0).alias("kind"), at(1).alias("flag"), nothing(at(2)).alias("strip"), nothing(F.get(add, F.lit(0))).alias("add"), _flags(F.get(add, F.lit(1)), kind).alias("more"), condition.alias("condition"))
    return rules.join(heads, ["kind", "flag"], "left").withColumn("crosses", F.coalesce("crosses", F.lit(False)))


def read_words(spark: SparkSession, path: str, flag_kind: str = "") -> DataFrame:
    """stem, flags of a word file; its first line, a count, is no word. A slash after a backslash belongs to the word."""
    fields = F.split(F.regexp_replace(F.trim("value"), r"\s.*$", ""), r"(?<!\\)/", 2)
    stem = F.replace(F.get(fields, F.lit(0)), F.lit("\\/"), F.lit("/"))
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[0-9]+\s*$"))
    return rows.select(stem.alias("stem"), _flags(F.get(fields, F.lit(1)), flag_kind).alias("flags")).where("stem <> ''")


def _affixed(words: DataFrame, rules: DataFrame, kind: str, few: bool) -> DataFrame:
    """words(stem, form, flags, ...) with each rule of this kind and of their flags applied: form is the new one; flag, crosses, more are the rule's."""
    each = words.withColumn("flag", F.explode("flags"))
    own = rules.where(F.col("kind") == kind).drop("kind")
    met = each.join(F.broadcast(own), "flag") if few else salted_join(each, own, "flag", "form")
    size = F.length("strip")
    if kind == "SFX":
        fits = F.endswith("form", "strip") & F.regexp_like("form", F.concat(F.col("condition"), F.lit("$")))
        form = F.concat(F.left("form", F.length("form") - size), "add")
    else:
        fits = F.startswith("form", "strip") & F.regexp_like("form", F.concat(F.lit("^"), F.col("condition")))
        form = F.concat("add", F.expr("substring(form, length(strip) + 1)"))
    return met.where(fits & (F.length("form") > size)).withColumn("form", form).drop("strip", "add", "condition")


def expanded(words: DataFrame, rules: DataFrame, need_affix: str | None = None, forbidden: str | None = None) -> DataFrame:
    """words(stem, flags), rules as of read_affixes -> form, stem, prefix, suffix (flags, or empty); each once."""
    few = rules.limit(FEW + 1).count() <= FEW
    base = words.where("stem <> ''").groupBy("stem").agg(F.array_distinct(F.flatten(F.collect_list("flags"))).alias("flags"))
    banned = base.where(F.array_contains("flags", forbidden)).select(F.col("stem").alias("form")) if forbidden else None
    base = base.where(~F.array_contains("flags", forbidden)) if forbidden else base
    stems = base.select("stem", F.col("stem").alias("form"), "flags", F.lit("").alias("suffix"), F.col("flags").alias("ahead"))
    once = _affixed(stems, rules, "SFX", few)
    once = once.select("stem", "form", F.col("more").alias("flags"), F.col("flag").alias("suffix"), F.when(F.col("crosses"), F.array_union("ahead", "more")).otherwise(F.expr("cast(array() as array<string>)")).alias("ahead"))
    twice = _affixed(once, rules, "SFX", few)
    twice = twice.select("stem", "form", F.col("more").alias("flags"), F.concat("suffix", "flag").alias("suffix"), F.when(F.col("crosses"), F.col("ahead")).otherwise(F.expr("cast(array() as array<string>)")).alias("ahead"))
    suffixed = stems.unionByName(once).unionByName(twice)
    ahead = _affixed(suffixed.withColumn("flags", F.col("ahead")).drop("ahead"), rules, "PFX", few).where("suffix = '' or crosses")
    bare = suffixed.where(~F.array_contains("flags", need_affix)) if need_affix else suffixed
    out = bare.select("form", "stem", F.lit("").alias("prefix"), "suffix").unionByName(ahead.select("form", "stem", F.col("flag").alias("prefix"), "suffix")).distinct()
    return out.join(banned, "form", "left_anti") if forbidden else out


def deletions(word: Column, edits: int) -> Column:
    """The distinct strings that are left of the word without up to `edits` of its characters."""
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))))
    step = lambda found, _: F.array_distinct(F.concat(found, F.flatten(F.transform(F.filter(found, lambda s: s != ""), less))))
    return reduce(step, range(edits), F.array(word))


def suggestions(words: DataFrame, forms: DataFrame, edits: int = 2, prefix: int = PREFIX) -> DataFrame:
    """words(word), forms(form) -> word, form, distance, of all pairs within `edits`; repeated rows count once."""
    keys = lambda df, c: df.where(F.col(c) != "").select(c).distinct().withColumn("key", F.explode(deletions(F.left(c, F.lit(prefix)), edits)))
    index, asked = keys(forms, "form"), keys(words, "word")
    pairs = salted_join(index, asked, "key", "form").where(F.abs(F.length("word") - F.length("form")) <= edits)
    # a pair has several keys in common: one row a pair before the distance is taken
    near = pairs.select("word", "form").distinct().withColumn("distance", F.levenshtein("word", "form", edits))
    return near.where("distance >= 0")


def readings(word: Column) -> Column:
    """What a word may stand as in a dictionary, best first: as it is, with a small first letter, all small, with one capital."""
    first = F.concat(F.lower(F.left(word, F.lit(1))), F.expr("substring(word, 2)"))
    capital = F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.expr("substring(word, 2)")))
    upper = (word == F.upper(word)) & (word != F.lower(word))
    capitalised = F.left(word, F.lit(1)) != F.lower(F.left(word, F.lit(1)))
    return F.array_distinct(F.when(upper, F.array(word, F.lower(word), capital)).when(capitalised, F.array(word, first)).otherwise(F.array(word)))


def corrections(words: DataFrame, forms: DataFrame, edits: int = 2) -> DataFrame:
    """words(word) -> word, known, reg: each non-empty word once; reg is the nearest form of an unknown one, or null.

    Of several nearest forms the one with the word's first letter comes first, then by name. A word in capitals, or with a capital,
    is looked up in small letters too, and its correction gets them back.
    """
    each = words.where("word <> ''").select("word").distinct().select("word", F.explode(readings(F.col("word"))).alias("read"))
    dictionary = forms.where("form <> ''").select("form").distinct()
    looked = each.join(dictionary, each.read == dictionary.form, "left").groupBy("word").agg(F.max(F.col("form").isNotNull()).alias("known"))
    looked = park(looked, "looked-up")
    unknown = looked.where("not known").select("word", F.explode(readings(F.col("word"))).alias("read"))
    found = suggestions(unknown.select(F.col("read").alias("word")), dictionary, edits).withColumnRenamed("word", "read")
    rank = F.struct("distance", (F.lower(F.left("form", F.lit(1))) != F.lower(F.left("word", F.lit(1)))).alias("other"), "form")
    best = unknown.join(found, "read").groupBy("word").agg(F.min(rank).alias("best"))
    form, word = F.col("best.form"), F.col("word")
    upper = (word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1)
    capitalised = F.left(word, F.lit(1)) != F.lower(F.left(word, F.lit(1)))
    reg = F.when(upper, F.upper(form)).when(capitalised, F.concat(F.upper(F.left(form, F.lit(1))), F.expr("substring(best.form, 2)"))).otherwise(form)
    return looked.join(best, "word", "left").select("word", "known", reg.alias("reg"))


def normalized(tokens: DataFrame, forms: DataFrame, edits: int = 2) -> DataFrame:
    """tokens(form, ...) with `reg`: the correction of a form that has letters only and isn't in the dictionary; else null."""
    asked = tokens.where(F.col("form").rlike(r"^\p{L}[\p{L}\p{M}]*$")).select(F.col("form").alias("word"))
    found = corrections(asked, forms, edits).where("reg is not null").select(F.col("word").alias("form"), "reg")
    # of ten million occurrences of one form, each part of them meets the correction
    return salted_join(tokens.drop("reg").withColumn("_row", F.monotonically_increasing_id()), found, "form", "_row", "left").drop("_row")
