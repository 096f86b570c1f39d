"""Benchmark results, catalogs and split assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT_KEY = ("language", "backend", "model", "treebank", "mode")


def averages(results: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Means by language, backend, model and mode, nulls left out, and the number of treebanks."""
    return results.groupBy("language", "backend", "model", "mode").agg(*(F.avg(m).alias(m) for m in measures), F.count("*").alias("treebanks"))


def upserted(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = RESULT_KEY, at: str = "timestamp") -> DataFrame:
    """Stored and new rows, of each key the latest; of equal times the new one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def ranked(results: DataFrame, metric: str) -> DataFrame:
    """Report order: metric falling, nulls last, then the key; `place` numbers it within each language."""
    w = Window.partitionBy("language").orderBy(F.desc_nulls_last(metric), *RESULT_KEY)
    return results.withColumn("place", F.row_number().over(w))


def language_coverage(treebanks: DataFrame, models: DataFrame) -> DataFrame:
    """language, treebanks, models: counts from both sides, 0 where one side lacks the language."""
    left = treebanks.groupBy("language").agg(F.count("*").alias("treebanks"))
    right = models.groupBy("language").agg(F.count("*").alias("models"))
    joined = left.join(right, "language", "full_outer")
    return joined.select("language", F.coalesce("treebanks", F.lit(0)).alias("treebanks"), F.coalesce("models", F.lit(0)).alias("models"))


def job_grid(models: DataFrame, treebanks: DataFrame, disabled: DataFrame) -> DataFrame:
    """Each enabled model with each treebank of its language: an equality join, as other pairs are no jobs."""
    enabled = models.join(disabled, ["backend", "model"], "left_anti")
    return enabled.join(treebanks, "language").select("language", "backend", "model", "treebank")


def preferred_models(catalog: DataFrame) -> DataFrame:
    """The preferred model of each (language, backend): installed first, then names ending in _full, then by name."""
    w = Window.partitionBy("language", "backend").orderBy(F.desc("installed"), F.col("model").endswith("_full").desc(), "model")
    return catalog.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def preferred_per_language(catalog: DataFrame, backends: tuple[str, ...]) -> DataFrame:
    """One model per language: installed first, then the order of `backends`, then by name."""
    rank = F.coalesce(*(F.when(F.col("backend") == b, k) for k, b in enumerate(backends)), F.lit(len(backends)))
    w = Window.partitionBy("language").orderBy(F.desc("installed"), rank, "model")
    return preferred_models(catalog).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def merged_registry(remote: DataFrame, local: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("backend", "model")) -> DataFrame:
    """Full outer join of two registries; local values count first."""
    r = remote.select(*keys, *(F.col(c).alias(f"r_{c}") for c in columns), F.lit(True).alias("in_remote"))
    joined = local.withColumn("in_local", F.lit(True)).join(r, list(keys), "full_outer")
    return joined.select(*keys, *(F.coalesce(c, f"r_{c}").alias(c) for c in columns), F.coalesce("in_local", F.lit(False)).alias("installed"), F.coalesce("in_remote", F.lit(False)).alias("remote"))


def split_assigned(rows: DataFrame, key: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, existing: DataFrame | None = None) -> DataFrame:
    """train, dev or test by a seeded hash of the key; rows with an `existing`(key, split) keep theirs. Shares sum to 1."""
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("shares must sum to 1")
    point = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    drawn = F.when(point < shares[0], "train").when(point < shares[0] + shares[1], "dev").otherwise("test")
    if existing is None:
        return rows.withColumn("split", drawn)
    joined = rows.join(existing.select(key, F.col("split").alias("_split")), key, "left")
    return joined.withColumn("split", F.coalesce("_split", drawn)).drop("_split")


def narrowed(results: DataFrame, languages: tuple[str, ...] = (), backends: tuple[str, ...] = (), modes: tuple[str, ...] = ()) -> DataFrame:
    """Results of these languages, backends and modes, whatever their case; an empty list lets all through, a missing mode is `auto`."""
    for column, names in ((F.col("language"), languages), (F.col("backend"), backends), (F.coalesce("mode", F.lit("auto")), modes)):
        if names:
            results = results.where(F.lower(column).isin(*(x.lower() for x in names)))
    return results


def summary(results: DataFrame) -> DataFrame:
    """One row: benchmarks, models (pairs of backend and model), languages, treebanks."""
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    pair = F.when(named("backend").isNotNull() & named("model").isNotNull(), F.struct("backend", "model"))
    return results.agg(F.count("*").alias("benchmarks"), F.countDistinct(pair).alias("models"), F.countDistinct(named("language")).alias("languages"), F.countDistinct(named("treebank")).alias("treebanks"))


def language_report(models: DataFrame) -> DataFrame:
    """models(language, backend, model) -> language, backends (sorted, joined by a comma), n_models."""
    return models.groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"), F.countDistinct("backend", "model").alias("n_models"))


def tag_usage(tokens: DataFrame, treebank: str) -> DataFrame:
    """field (UPOS or FEATS), name, upos, treebank, cnt: how often a tag, or a feature with a tag, occurs in each treebank."""
    pair = F.explode(F.filter(F.split("feats", r"\|"), lambda x: x.contains("=")))
    tags = tokens.select(F.lit("UPOS").alias("field"), F.col("upos").alias("name"), "upos", F.col(treebank).alias("treebank"))
    feats = tokens.select("upos", F.col(treebank).alias("treebank"), pair.alias("pair")).select(F.lit("FEATS").alias("field"), F.substring_index("pair", "=", 1).alias("name"), "upos", "treebank")
    return tags.unionByName(feats).groupBy("field", "name", "upos", "treebank").agg(F.count("*").alias("cnt"))


def discovered(treebanks: DataFrame, language: str, limit: int | None = None) -> DataFrame:
    """treebanks(language, path): those of a language, the first `limit` of them by path."""
    found = treebanks.where(F.lower("language") == language.lower())
    return found if limit is None else found.orderBy("path").limit(limit)


def sessions(rows: DataFrame, now: str, stale: str = "INTERVAL 1 HOUR", include_completed: bool = False) -> DataFrame:
    """rows(session_id, status, started, seen), newest first: the running ones, last seen within `stale`, and, if asked for, the others as completed."""
    live = (F.col("status") == "running") & (F.expr(f"seen >= {now} - {stale}"))
    out = rows.withColumn("status", F.when((F.col("status") == "running") & ~live, "completed").otherwise(F.col("status")))
    return (out if include_completed else out.where(live)).orderBy(F.desc("started"), "session_id")


def natural_key(name: Column, width: int = 20) -> Column:
    """A string that sorts like the name with its numbers read as numbers, whatever its case; null sorts as empty."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=[0-9])", ""), width, "0")).otherwise(x)), "")


def tagging_stats(tagged: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: words, words that no lexicon step knew, seconds, words a second (null without seconds)."""
    per = F.lit(None).cast("double") if not seconds else F.count("*") / seconds
    return tagged.agg(F.count("*").alias("words"), F.count(F.when(~F.col("source").isin("exact", "lower", "normalized"), 1)).alias("oov"), F.lit(seconds).cast("double").alias("seconds"), per.alias("words_per_second"))
