"""What the training-data operators share: shared-folder tables, word splitting, hashing, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.shared import park

#: Rows without a doc_id take this key inside an operator; it sorts after every real id.
NO_ID = (1 << 63) - 1
def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores in front until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once although a lambda inside body uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as the struct `rest`, all columns beside text: no column can clash with an operator's own."""
    rest = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"))
    return docs.select("doc_id", "text", rest.alias("rest"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that further columns can't clash with ours; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def binary_rows(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of a word, computed once; emptied when it holds too many words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: Odd multipliers of the positions of a word window and of the final mix; fixed values.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= _STEP
            out += words[k : k + n]
        return mixed(out)


def smallest_labels(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges (a, b), for every node of an edge.

    Each turn takes the smallest label among the neighbours, then the label of that label; turns end when
    nothing changes. Every turn is a parked table, none is collected.
    """
    both = park(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = park(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        after = park(stepped.join(up, stepped.label == up.up, "left").select("node", "was", F.least("label", F.coalesce("upper", "label")).alias("label")), f"{name}-labels")
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels
