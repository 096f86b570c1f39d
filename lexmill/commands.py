"""What a user asks for by name: process, train, convert, map tags, evaluate, validate. Each is a short plan over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import evaluation, model, training
from lexmill.operators import tokens as tk
from lexmill.sources import conllu, registry, teitok, validation

#: Columns of a token table and what they are where a format lacks them.
ANNOTATION = {"lemma": "_", "upos": "_", "xpos": "_", "feats": "_", "head": "0", "deprel": "_"}
MODES = ("auto", "raw", "tokenized", "split")


def tokens_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """PLACE, form, annotation, space_after of the files under a path: `raw` (text files), `conllu` or `teitok`."""
    if kind == "raw":
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        docs = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))
        return tk.with_space_after(tk.token_table(docs)).select(*tk.PLACE, "form", *(F.lit(v).alias(c) for c, v in ANNOTATION.items()), "space_after").withColumn("head", F.col("head").cast("int"))
    rows = {"conllu": conllu.read, "teitok": teitok.read}[kind](spark, path)
    rows = rows.withColumn("line_no", F.lit(0))
    if "tok_no" not in rows.columns:
        rows = rows.withColumn("tok_no", F.col("row_no"))
    return rows.select(*tk.PLACE, "form", *(F.coalesce(F.col(c).cast("string"), F.lit(v)).alias(c) for c, v in ANNOTATION.items()), "space_after").withColumn("head", F.coalesce(F.col("head").try_cast("int"), F.lit(0)))


def process(tokens: DataFrame, m: model.Model, tasks: tuple[str, ...] = ("tag", "lemmatize")) -> DataFrame:
    """The tokens with what the tasks fill in."""
    names = registry.task_names(list(tasks))
    found = model.tagged(m, tokens)
    out = tokens.drop("lemma", "upos", "xpos", "feats").join(found.drop("form", "tag", "source"), list(tk.PLACE))
    gone = [c for task, columns in (("lemmatize", ("lemma",)), ("tag", ("upos", "feats")), ("xpos", ("xpos",))) if task not in names and not (task == "xpos" and "tag" in names) for c in columns]
    return tk.detagged(out.select(*tokens.columns), tuple(gone))


def convert(tokens: DataFrame, kind: str) -> DataFrame:
    """doc_id and the text of a format: conllu, conllu-ne, teitok or json."""
    return registry.writers.get(kind)(tokens)


def train(tokens: DataFrame, path: str, **settings) -> None:
    model.save(model.trained(tokens, **settings), path)


def validate(spark: SparkSession, path: str, smart: bool = True) -> DataFrame:
    """doc_id, sent_no, id, problem of the CoNLL-U files under a path; `smart` leaves out what is only not annotated."""
    return validation.of_path(spark, path, smart)


def map_tags(tokens: DataFrame, source: DataFrame, direction: str = "both") -> DataFrame:
    return training.with_mapped_tags(tokens, source, direction)


def evaluate(gold: DataFrame, m: model.Model, mode: str = "auto") -> DataFrame:
    """metric, correct, total, accuracy of a model on gold tokens.

    `tokenized`: gold tokens without their annotation are tagged; `split`: gold sentences are tokenized anew;
    `raw`: gold documents are segmented and tokenized anew. `auto` is `tokenized`. Tokens made anew are aligned with the gold ones.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")
    if mode in ("auto", "tokenized"):
        found = model.tagged(m, tk.detagged(gold))
        return evaluation.metrics(evaluation.same_place(gold, found, ("form", "upos", "xpos", "feats", "lemma")))
    texts = conllu.sentence_bodies(gold).select(*tk.SENTENCE, "text")
    if mode == "split":
        rows = texts.select(*tk.SENTENCE, F.posexplode(tk.t.tokens(F.col("text"))).alias("tok_no", "form"))
    else:
        ordered = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "sent_no", "text"))).alias("ts"))
        rows = tk.token_table(ordered.select("doc_id", F.array_join("ts.text", " ").alias("text")))
    found = model.tagged(m, rows)

    def numbered(tokens: DataFrame) -> DataFrame:
        bounds = tk.sentence_bounds(tokens)
        sentence = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("line_no", "sent_no")) - 1
        bounds = bounds.withColumn("number", sentence)
        return tokens.join(bounds.select(*tk.SENTENCE, "tok_start", "number"), list(tk.SENTENCE)).withColumn("n", F.col("tok_start") + F.col("tok_no"))

    g, p = numbered(gold), numbered(found)
    side = lambda rows: rows.select("doc_id", "n", F.col("number").alias("sent_no"), "form")
    pairs = evaluation.align(side(g), side(p)).select("doc_id", F.col("g").alias("n"), F.col("p").alias("pred_n"))
    columns = ("form", "upos", "xpos", "feats", "lemma")
    met = g.join(pairs, ["doc_id", "n"], "left").join(p.select("doc_id", F.col("n").alias("pred_n"), *(F.col(c).alias(f"pred_{c}") for c in columns)), ["doc_id", "pred_n"], "left")
    return evaluation.metrics(met.withColumn("aligned", F.col("pred_n").isNotNull()))
