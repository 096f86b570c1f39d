"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with their columns; the last one
returns their tokens. A stage works on all that its predecessor kept, written as a table in the shared
folder and read again.

Defined cases, for every stage: a table without rows gives one without rows; a null text counts as empty;
columns beside doc_id and text may have any name and come through as they are, but for n_chars, which line
dedup sets anew where it has changed a text. What a stage does with null ids and repeated rows stands there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import common, decontaminate, line_dedup, near_dedup, pieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Each row is scored alone: null ids and repeated rows make no difference."""
    known = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    net = toxicity.fit(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.unused("score", docs.columns)
    return toxicity.scored(docs, net, score).where(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, and documents that lose all their words.

    Documents are in the order of doc_id, null last, and of a hash of the text; repeated rows are one document and stay alike.
    """
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id.

    Of several rows of that doc_id, repeated ones included, the one with the smallest hash of its text stays. Rows without a doc_id stay.
    """
    gone = near_dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("at")).distinct()
    at = F.col("doc_id").cast("long")
    rows = common.packed(docs).select("rest", "text", at.alias("at"))
    left = rows.join(gone, "at", "left_anti")
    # rows without an id are each on their own
    own = Window.partitionBy("at", F.when(F.col("at").isNull(), F.monotonically_increasing_id())).orderBy(F.xxhash64("text"))
    left = left.withColumn("nth", F.row_number().over(own)).where("nth = 1")
    return left.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go, whatever their doc_id; repeated rows go together."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids of each row; a null text counts as empty and has no pieces."""
    tokens = pieces.encoded(common.keyed(docs))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: A trained network and an edit join aren't SQL; tests/llm/test_pipeline.py holds all stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.park(docs, f"pipeline-{name}")
    return docs
