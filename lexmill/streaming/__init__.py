"""Annotation of text streams. All of it is stateless but the running vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators import tokens as tk

DOCUMENTS = "doc_id long, text string, lang string"


def text_stream(spark: SparkSession, path: str, schema: str | T.StructType = DOCUMENTS, files_per_batch: int = 16) -> DataFrame:
    """Documents of parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def token_stream(docs: DataFrame) -> DataFrame:
    """Token rows; the generators need no state, so this is append-only."""
    return tk.token_table(docs, "lang")


def running_vocabulary(docs: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """form, n over all that has come (to be written in complete or update mode); with a time column, per window,
    where rows later than `late` are left out and finished windows are dropped from the state."""
    if time is None:
        return token_stream(docs).groupBy("form").agg(F.count("*").alias("n"))
    rows = docs.withWatermark(time, late)
    forms = rows.select(time, F.explode(F.flatten(F.transform(tk.t.lines(F.col("text")), tk.t.tokens))).alias("form"))
    return forms.groupBy(F.window(time, window).alias("window"), "form").agg(F.count("*").alias("n"))
