"""Language by character trigrams: profiles from texts of known language, scores of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import kernels
from lexmill.functions import text as t

PENALTY = 300.0
#: The prefix that the registered queries and their SQL look at.
MOST_CHARS = 20_000


def each_trigram(docs: DataFrame, *keep: str, most_chars: int | None = None) -> DataFrame:
    """One row per trigram of a lower-cased text (of its first `most_chars` code points, if given): keep, trigram.

    A text is split into its code points once; neighbours are then read off by place.
    """
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    text = text if most_chars is None else F.substring(text, 1, most_chars)
    each = docs.select(*keep, F.split(text, "").alias("cs"))
    each = each.select(*keep, "cs", F.posexplode("cs").alias("at", "c")).where(F.col("at") + 2 < F.size("cs"))
    return each.select(*keep, F.concat("c", F.get("cs", F.col("at") + 1), F.get("cs", F.col("at") + 2)).alias("trigram"))


def trigrams(docs: DataFrame, *keep: str, most_chars: int | None = None) -> DataFrame:
    """One row per different trigram of a text: doc_id, keep, trigram, n. Texts are dealt by doc_id first, so what is counted per document needs no further shuffle."""
    dealt = docs.select("doc_id", *keep, "text").repartition("doc_id")
    return each_trigram(dealt, "doc_id", *keep, most_chars=most_chars).groupBy("doc_id", *keep, "trigram").agg(F.count("*").alias("n"))


def profiles(docs: DataFrame, size: int = 300, most_chars: int | None = None) -> DataFrame:
    """lang, trigram, rank of the `size` most frequent trigrams of each language (ties by trigram), counted over whole texts by default."""
    counts = each_trigram(docs, "lang", most_chars=most_chars).groupBy("lang", "trigram").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "trigram")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).select("lang", "trigram", "rank")


def scores(docs: DataFrame, known: DataFrame, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """doc_id, lang, score in 0..1: one less the mean distance of count and rank, PENALTY for trigrams a profile lacks.

    Only the first `most_chars` code points of a text are looked at, as in the reference's detection.
    A trigram that a profile lacks adds nothing to what the distances leave of PENALTY, so only trigrams of a
    profile are multiplied by its languages; the others are counted. Profiles are languages times 300 rows: they are broadcast.
    """
    langs = known.select("lang").distinct()
    by_gram = known.groupBy("trigram").agg(F.collect_list(F.struct("lang", "rank")).alias("ranks"))
    grams = trigrams(docs, most_chars=most_chars).join(F.broadcast(by_gram), "trigram", "left")
    # a row without a language counts the trigram
    none = F.array(F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("rank")))
    each = grams.select("doc_id", "n", F.inline(F.concat(none, F.coalesce("ranks", F.array().cast("array<struct<lang:string,rank:int>>")))))
    left = F.sum(PENALTY - F.abs(F.col("n") - F.col("rank")))
    per = each.groupBy("doc_id", "lang").agg(left.alias("left"), F.count("*").alias("grams"))
    own = per.groupBy("doc_id").agg(F.max(F.when(F.col("lang").isNull(), F.col("grams"))).alias("grams"), F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "left")))).alias("of"))
    whole = PENALTY * F.col("grams")
    score = F.greatest(F.lit(0.0), 1 - (whole - F.coalesce(F.try_element_at("of", "lang"), F.lit(0.0))) / whole)
    return own.join(F.broadcast(langs), F.lit(True)).select("doc_id", "lang", score.alias("score"))


def detected(scored: DataFrame, k: int = 2) -> DataFrame:
    """doc_id, best language, score, and whether the second is at most four fifths of it; no row at score 0."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "lang")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(2, k))
    best = ranked.groupBy("doc_id").agg(F.min_by("lang", "rank").alias("lang"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return best.where("score > 0").select("doc_id", "lang", "score", (F.coalesce(F.col("second") / F.col("score"), F.lit(0.0)) <= 0.8).alias("reliable"))


def resolved(queries: DataFrame, languages: DataFrame, least: float = 0.65) -> DataFrame:
    """queries(q), languages(iso1, iso3, name) -> q, iso (two letters, else three), name, how: `code`, `name`, `fuzzy` or `none`.

    A code is two or three letters; names are compared without case, marks and blanks; of names that are alike to
    `least` or more the most alike counts. The list of languages is a table of a few thousand rows and is broadcast.
    """
    names = F.broadcast(languages.select("iso1", "iso3", "name", t.plain_name(F.col("name")).alias("plain")))
    code = F.lower(F.trim("q"))
    rows = queries.select("q").distinct().withColumn("code", F.when(code.rlike("^[a-z]{2,3}$"), code)).withColumn("key", t.plain_name(F.col("q")))
    met = lambda on, how: rows.join(names, on).select("q", F.coalesce("iso1", "iso3").alias("iso"), "name", F.lit(how).alias("how"), F.lit(1.0).alias("score"))
    by_code = met((F.col("code") == F.col("iso1")) | (F.col("code") == F.col("iso3")), "code")
    by_name = met(F.col("key") == F.col("plain"), "name")
    exact = by_code.unionByName(by_name)
    rest = rows.join(exact.select("q").distinct(), "q", "left_anti").where("key <> ''")
    fuzzy = rest.join(names, F.lit(True)).withColumn("score", kernels.likeness(F.col("plain"), F.col("key"))).where(F.col("score") >= least)
    every = exact.unionByName(fuzzy.select("q", F.coalesce("iso1", "iso3").alias("iso"), "name", F.lit("fuzzy").alias("how"), "score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "how", "iso")
    best = every.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("q", "iso", "name", "how")
    return queries.join(best, "q", "left").withColumn("how", F.coalesce("how", F.lit("none")))
