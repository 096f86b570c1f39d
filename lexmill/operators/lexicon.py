"""Lexica and positional tagsets as tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.sources.shared import park

#: Main categories of positional tags and the universal tags they stand for; fixed values.
POSITIONAL_UPOS = {"A": "ADJ", "R": "ADV", "D": "DET", "N": "NOUN", "NP": "PROPN", "V": "VERB", "P": "PRON", "C": "CCONJ", "I": "INTJ", "S": "ADP", "F": "PUNCT", "Z": "NUM", "X": "X"}
#: Features by their names in English, Spanish and Portuguese tagsets; fixed values.
FEATURE_NAMES = {"gender": "Gender", "género": "Gender", "gen": "Gender", "number": "Number", "número": "Number", "num": "Number", "person": "Person", "persona": "Person", "mood": "Mood", "modo": "Mood", "tense": "Tense", "tiempo": "Tense", "case": "Case", "caso": "Case", "degree": "Degree", "grado": "Degree", "form": "Form", "forma": "Form"}
#: Values of features by their names in those languages; fixed values. Others are the tag's own character.
FEATURE_VALUES = {
    "Gender": {"masculine": "Masc", "masculino": "Masc", "m": "Masc", "feminine": "Fem", "femenino": "Fem", "f": "Fem", "common": "Com", "común": "Com", "comum": "Com", "c": "Com", "neutral": "Neut", "neutro": "Neut", "n": "Neut"},
    "Number": {"singular": "Sing", "s": "Sing", "plural": "Plur", "p": "Plur"},
    "Person": {"first": "1", "primera": "1", "primeira": "1", "second": "2", "segunda": "2", "third": "3", "tercera": "3", "terceira": "3"},
    "Mood": {"indicative": "Ind", "indicativo": "Ind", "i": "Ind", "subjunctive": "Sub", "subjuntivo": "Sub", "conjuntivo": "Sub", "s": "Sub", "imperative": "Imp", "imperativo": "Imp", "m": "Imp", "infinitivo": "Inf", "gerund": "Ger", "gerundio": "Ger", "gerúndio": "Ger", "g": "Ger", "participle": "Part", "participio": "Part", "particípio": "Part", "p": "Part"},
    "Tense": {"present": "Pres", "presente": "Pres", "p": "Pres", "imperfective": "Imp", "pretérito imperfecto": "Imp", "pretérito imperfeito": "Imp", "i": "Imp", "future": "Fut", "futuro": "Fut", "f": "Fut", "past": "Past", "pretérito perfecto": "Past", "pretérito perfeito": "Past", "s": "Past", "conditional": "Cond", "condicional": "Cond", "c": "Cond"},
    "Case": {"nominative": "Nom", "nominativo": "Nom", "n": "Nom", "accusative": "Acc", "acusativo": "Acc", "a": "Acc", "dative": "Dat", "dativo": "Dat", "d": "Dat", "oblique": "Obl", "oblicuo": "Obl", "oblíquo": "Obl", "o": "Obl"},
}

TAGSET = "cat string, upos string, pos int, char string, feat string, value string"


def tagset_rows(xml: str) -> list[tuple]:
    """(category, upos, position, character, feature, value) of a tagset's XML; a category without positions has one row of its own.

    Categories of two letters (<multi>) have the positions of the one-letter category they stand in.
    """
    positions = next((x for x in ET.fromstring(xml).iter("positions")), None)
    if positions is None:
        raise ValueError("a tagset needs <positions>")
    out = []
    for item in positions.findall("item"):
        key = item.get("key")
        if not key:
            continue
        upos = POSITIONAL_UPOS.get(key, "X")
        cats = [(key, upos)] + [(m.get("key"), POSITIONAL_UPOS.get(m.get("key"), upos)) for multi in item.findall("multi") for m in multi.findall("item") if m.get("key")]
        values = []
        for place in item.findall("item[@pos]"):
            name = (place.get("display") or "").lower()
            feat = FEATURE_NAMES.get(name)
            for value in place.findall("item"):
                char, shown = value.get("key", ""), (value.get("display") or "").strip()
                if char and not (char == "0" and not shown):
                    meant = FEATURE_VALUES.get(feat, {}).get(shown.lower()) or char.upper()
                    values.append((int(place.get("pos")), char, feat, meant if feat and char != "0" else None))
        for cat, tag in cats:
            out += [(cat, tag, *v) for v in values] or [(cat, tag, None, None, None, None)]
    return out


def read_tagset(spark: SparkSession, path: str) -> DataFrame:
    """The tables of tagset XML files under a path."""
    rows = spark.read.text(path, wholetext=True)
    fields = [pa.field(n, pa.int32() if k == "int" else pa.string()) for n, k in (x.split() for x in TAGSET.split(", "))]

    @F.arrow_udf(f"array<struct<{', '.join(f'{n}:{k}' for n, k in (x.split() for x in TAGSET.split(', ')))}>>")
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip((f.name for f in fields), r, strict=True)) for r in tagset_rows(x)] for x in texts.to_pylist()], pa.list_(pa.struct(fields)))

    return rows.select(F.inline(parse(F.col("value"))))


def positional_tags(tags: DataFrame, tagset: DataFrame) -> DataFrame:
    """tags(xpos) -> xpos, upos, feats, by the tagset; an unknown category gives X and no features.

    The category is the first two characters where these are one whose universal tag differs from that of
    the first alone (as NP beside N), else the first one. Characters behind it are looked up by their place.
    """
    cats = tagset.select("cat", "upos").distinct()
    rows = tags.select("xpos").distinct()
    one = cats.select(F.col("cat").alias("one"), F.col("upos").alias("upos_1"))
    two = cats.where(F.length("cat") == 2).select(F.col("cat").alias("two"), F.col("upos").alias("upos_2"))
    rows = rows.join(F.broadcast(two), F.substring("xpos", 1, 2) == F.col("two"), "left").join(F.broadcast(one), F.substring("xpos", 1, 1) == F.col("one"), "left")
    long = F.col("two").isNotNull() & ~F.coalesce(F.col("upos_1") == F.col("upos_2"), F.lit(False))
    rows = rows.select("xpos", F.when(long, F.col("two")).otherwise(F.col("one")).alias("cat"), F.coalesce(F.when(long, F.col("upos_2")).otherwise(F.col("upos_1")), F.lit("X")).alias("upos"))
    rest = F.when(F.col("cat").isNotNull(), F.expr("substring(xpos, length(cat) + 1)")).otherwise("")
    each = rows.select("xpos", "cat", "upos", F.posexplode_outer(F.filter(F.split(rest, ""), lambda c: c != "")).alias("k", "char")).withColumn("pos", F.col("k") + 1)
    known = tagset.where("value is not null").select("cat", "pos", "char", "feat", "value").distinct()
    feats = each.join(F.broadcast(known), ["cat", "pos", "char"], "left").groupBy("xpos", "upos").agg(F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.concat_ws("=", "feat", "value")))).alias("fs"))
    empty = F.col("xpos").isin("_", "")
    return feats.select("xpos", F.when(empty, "_").otherwise(F.col("upos")).alias("upos"), F.when(empty | (F.size("fs") == 0), "_").otherwise(F.array_join("fs", "|")).alias("feats"))


def xpos_frequencies(tokens: DataFrame) -> DataFrame:
    """How often each xpos occurs: xpos, cnt."""
    return tokens.where(~F.coalesce(F.col("xpos"), F.lit("_")).isin("_", "")).groupBy("xpos").agg(F.count("*").alias("cnt"))


def parsed_unimorph(lines: DataFrame, line: str = "value", readings: DataFrame | None = None) -> DataFrame:
    """Lines of lemma, form and features, tab-separated -> vocab(form, lemma, upos, xpos, feats, cnt).

    readings(xpos, upos, feats, cnt), of a corpus through its tagset: an entry gets the most frequent xpos of its
    reading, else of one that has all its features and more.
    """
    parts = F.split(F.trim(line), "\t")
    rows = lines.where(~F.trim(line).startswith("#")).select(F.trim(F.get(parts, F.lit(0))).alias("lemma"), F.trim(F.get(parts, F.lit(1))).alias("form"), t.unimorph_to_ud(F.trim(F.coalesce(F.get(parts, F.lit(2)), F.lit("")))).alias("u"))
    rows = rows.where("lemma <> '' and form <> ''").select("form", F.lower("lemma").alias("lemma"), "u.upos", "u.feats")
    if readings is None:
        return rows.select("form", "lemma", "upos", F.lit("_").alias("xpos"), "feats", F.lit(1).cast("long").alias("cnt"))
    wanted = rows.where("upos <> '_' and feats <> '_'").select("upos", "feats").distinct()
    r = readings.select(F.col("upos").alias("r_upos"), F.col("feats").alias("r_feats"), "xpos", "cnt")
    # different readings are few
    met = wanted.join(F.broadcast(r), (F.col("upos") == F.col("r_upos")) & t.feats_within(F.col("feats"), F.col("r_feats")))
    w = Window.partitionBy("upos", "feats").orderBy((F.col("feats") == F.col("r_feats")).desc(), F.desc("cnt"), "xpos")
    best = met.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("upos", "feats", "xpos")
    return rows.join(F.broadcast(best), ["upos", "feats"], "left").select("form", "lemma", "upos", F.coalesce("xpos", F.lit("_")).alias("xpos"), "feats", F.lit(1).cast("long").alias("cnt"))


def read_unimorph(spark: SparkSession, path: str, readings: DataFrame | None = None) -> DataFrame:
    return parsed_unimorph(spark.read.text(path), "value", readings)


def default_emissions(vocab: DataFrame, tag: str = "upos", smoothing: float = 0.1) -> DataFrame:
    """tag, probability of an unknown word: (count + smoothing) / (all + smoothing * tags)."""
    counts = vocab.where(~F.coalesce(F.col(tag), F.lit("_")).isin("_", "")).groupBy(F.col(tag).alias("tag")).agg(F.sum("cnt").alias("cnt"))
    whole = counts.agg(F.sum("cnt").alias("total"), F.count("*").alias("tags"))
    return counts.crossJoin(F.broadcast(whole)).select("tag", ((F.col("cnt") + smoothing) / (F.col("total") + smoothing * F.col("tags"))).alias("probability"))  # one row


def split_clitics(words: DataFrame, clitics: DataFrame, vocab: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """words(form), clitics(clitic, side: left or right, upos, prob), vocab(form, upos, cnt) -> form, host, clitic, side, upos, score.

    A word that the vocabulary lacks falls into a known host and a clitic before or behind it; of several ways
    that with the largest product of probabilities counts, then the longest clitic. `allowed`: universal tags of hosts.
    """
    known = vocab.groupBy("form").agg(F.sum("cnt").alias("all"))
    best = vocab.where(F.col("upos").isin(*allowed)) if allowed else vocab
    best = best.groupBy("form", "upos").agg(F.sum("cnt").alias("cnt")).join(known, "form").select(F.col("form").alias("host"), F.col("upos").alias("host_upos"), (F.col("cnt") / F.col("all")).alias("host_prob"))
    rest = words.select("form").distinct().join(known, "form", "left_anti")
    # every cut of a word is looked up among the clitics, which are few
    cuts = rest.select("form", F.explode(F.sequence(F.lit(1), F.greatest(F.length("form") - 1, F.lit(1)))).alias("k")).where("k < length(form)")
    cuts = cuts.select("form", F.substring("form", F.lit(1), F.col("k")).alias("first"), F.substring("form", F.col("k") + 1, F.length("form")).alias("second"))
    sides = cuts.select("form", F.inline(F.array(F.struct(F.lit("left").alias("side"), F.col("first").alias("clitic"), F.col("second").alias("host")), F.struct(F.lit("right").alias("side"), F.col("second").alias("clitic"), F.col("first").alias("host")))))
    met = sides.join(F.broadcast(clitics), ["clitic", "side"]).join(best, "host")
    scored = met.withColumn("score", F.col("prob") * F.col("host_prob"))
    w = Window.partitionBy("form").orderBy(F.desc("score"), F.desc(F.length("clitic")), "side", "host_upos", "upos")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("form", "host", "host_upos", "clitic", "side", "upos", "score")


def regular_forms(words: DataFrame, regs: DataFrame, vocab: DataFrame, suffixes: DataFrame | None = None, replaced: DataFrame | None = None) -> DataFrame:
    """words(form) -> form, reg, how: `explicit`, `morphology`, `substitution` or `same`.

    regs(form, reg) are the dominant regular forms of the lexicon, vocab(form, cnt) its words.

    1. A word that is a regular form itself stays.
    2. Its own regular form, or its lower-case form's, if that isn't a matter of case or of one punctuation mark, is
       known (as a word or a regular form, in any case) and, for a word seen 100 times, seen ten times as
       often. If the regular form has a regular form of its own, that is taken.
    3. With `suffixes`(suffix, cnt): the word less a suffix (the most frequent, then the longest first) has a regular form,
       and that with the suffix is known.
    4. With `replaced`(old, new, cnt), for words the lexicon lacks: the replacements are tried from the most frequent
       on; each one that leads to a known word, or a regular form, is made, so that several may be.
    """
    forms = words.select("form").distinct()
    known = vocab.groupBy("form").agg(F.sum("cnt").alias("freq"))
    low = known.groupBy(F.lower("form").alias("form")).agg(F.max("freq").alias("low_freq"))
    regular = regs.select(F.lower("reg").alias("key")).distinct().withColumn("is_reg", F.lit(True))
    mark = r"^\p{P}$"
    usable = regs.where((F.lower("form") != F.lower("reg")) & ~(F.col("form").rlike(mark) & F.col("reg").rlike(mark)) & ~F.col("reg").isin("", "_", "--"))
    usable = usable.groupBy("form").agg(F.min("reg").alias("reg"))

    def frequency(rows: DataFrame, of: str, name: str) -> DataFrame:
        """Adds the frequency of a word, or of its lower-case form; null if both are unknown."""
        out = rows.join(known.select(F.col("form").alias(of), F.col("freq").alias("_f")), of, "left")
        out = out.join(low.select(F.col("form").alias("_low"), F.col("low_freq").alias("_l")), F.lower(of) == F.col("_low"), "left")
        return out.withColumn(name, F.coalesce("_f", "_l")).drop("_f", "_l", "_low")

    def regular_of(rows: DataFrame, of: str, name: str) -> DataFrame:
        out = rows.join(usable.select(F.col("form").alias(of), F.col("reg").alias("_a")), of, "left")
        out = out.join(usable.select(F.col("form").alias("_low"), F.col("reg").alias("_b")), (F.lower(of) == F.col("_low")) & (F.lower(of) != F.col(of)), "left")
        return out.withColumn(name, F.coalesce("_a", "_b")).drop("_a", "_b", "_low")

    def is_regular(rows: DataFrame, of: str, name: str) -> DataFrame:
        return rows.join(regular.select(F.col("key").alias("_key"), F.col("is_reg").alias(name)), F.lower(of) == F.col("_key"), "left").drop("_key")

    out = is_regular(forms, "form", "_regular")
    out = regular_of(out, "form", "_reg")
    out = frequency(is_regular(frequency(regular_of(out, "_reg", "_again"), "form", "_own"), "_reg", "_listed"), "_reg", "_reg_freq")
    there = F.col("_reg_freq").isNotNull() | F.col("_listed")
    often = (F.coalesce("_own", F.lit(0)) < 100) | (F.col("_own") * 10 <= F.coalesce("_reg_freq", F.lit(0)))
    explicit = F.when(F.col("_reg").isNotNull() & (F.lower("_reg") != F.lower("form")) & there & often, F.coalesce("_again", "_reg"))
    out = out.select("form", "_regular", "_own", explicit.alias("explicit"))

    out = out.withColumn("morphology", F.lit(None).cast("string"))
    if suffixes is not None:
        ends = out.where("_regular is null and explicit is null").select("form", F.lower("form").alias("low"))
        ends = ends.select("form", "low", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).where("length(low) > n + 2")
        ends = ends.select("form", F.expr("right(low, n)").alias("suffix"), F.expr("substring(low, 1, length(low) - n)").alias("base")).join(F.broadcast(suffixes.select("suffix", F.col("cnt").alias("times"))), "suffix")
        ends = frequency(regular_of(ends, "base", "_base").where("_base is not null").withColumn("made", F.concat("_base", "suffix")), "made", "_made").where("_made is not null")
        w = Window.partitionBy("form").orderBy(F.desc("times"), F.desc(F.length("suffix")), "suffix")
        best = ends.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("form", F.col("made").alias("_morph"))
        out = out.join(best, "form", "left").withColumn("morphology", F.col("_morph")).drop("_morph")
    out = out.withColumn("substitution", F.lit(None).cast("string"))
    if replaced is not None:
        # each turn makes one replacement per word; a word takes as many turns as it has letters to replace
        turn = out.where("_regular is null and explicit is null and morphology is null and _own is null").select("form", F.lower("form").alias("now"), F.lit(0).alias("after"))
        order = replaced.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cnt"), "old", "new"))).select("old", "new", "place")
        done = None
        while not turn.isEmpty():
            each = turn.withColumn("old", F.explode(F.array_distinct(F.split("now", "")))).join(F.broadcast(order), "old").where("place > after")
            each = frequency(is_regular(each.withColumn("made", F.replace("now", "old", "new")), "made", "_listed"), "made", "_made").where("_made is not null or _listed")
            w = Window.partitionBy("form").orderBy("place")
            step = each.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("form", "made", "place")
            turn = park(regular_of(step, "made", "_again").select("form", F.coalesce("_again", "made").alias("now"), F.col("place").alias("after")), "replaced")
            done = turn if done is None else done.unionByName(turn)
        if done is not None:
            last = done.groupBy("form").agg(F.max_by("now", "after").alias("_subst"))
            out = out.join(last, "form", "left").withColumn("substitution", F.when(F.col("_subst") != F.lower("form"), F.col("_subst"))).drop("_subst")
    how: Column = F.when(F.col("_regular"), "same").when(F.col("explicit").isNotNull(), "explicit").when(F.col("morphology").isNotNull(), "morphology").when(F.col("substitution").isNotNull(), "substitution").otherwise("same")
    reg = F.when(how == "explicit", F.col("explicit")).when(how == "morphology", F.col("morphology")).when(how == "substitution", F.col("substitution")).otherwise(F.col("form"))
    return words.join(out.select("form", reg.alias("reg"), how.alias("how")), "form")
