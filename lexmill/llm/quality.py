"""Quality rules with the line frequency of the whole corpus.

Words are runs of anything but ASCII white space. Per document: characters in words, symbols, repeated
lines, words in repeated three-word windows, and from these the base rule (fewer than 50 words, or over
half of the words in repeated windows, fails).

The method: each line with a word is normalised (A-Z lower-cased, white space collapsed) and hashed to 128
bits; for each host the distinct documents that hold a line are counted, where documents with the same
text are one document, so that a page copied many times doesn't make its own lines frequent. A line is over
the limit if more than `most_docs` documents of its host hold it and these are more than `most_share` of
the host's documents. Lines over the limit are removed; a document left with less than `least_left` of its
words is rejected.

Skew: a line on every page of a host is one key. Counting drops repeats on the map side; for the join back,
the few lines over the limit are copied to `SALTS` salts and the documents spread over them.

Defined cases: null text has no words and fails the base rule; an empty table gives an empty result;
repeated rows give repeated result rows and count as one document; a null source is a host of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import binary_rows, map_batches, park

SYMBOLS = re.compile(rb"[#*$%&|<>]")
SALTS = 16


def repeated_words(words: list[bytes]) -> int:
    """Words that a three-word window found twice or more in the text covers."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    if len(ids) < 1 << 21:
        keys = (a[:-2] * len(ids) + a[1:-1]) * len(ids) + a[2:]
        _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        _, at, times = np.unique(np.stack([a[:-2], a[1:-1], a[2:]]), axis=1, return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each normalised line by its hash."""
    words = text.split()
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode("utf-8", "surrogatepass"))
    seen: set[bytes] = set()
    again, lines = 0, {}
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            again += 1
        seen.add(line)
        key = xxhash.xxh3_128_digest(b" ".join(own).lower())
        lines[key] = lines.get(key, 0) + len(own)
    return len(words), chars, len(SYMBOLS.findall(text)), again, repeated_words(words), lines


def _measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, digests, lines = [], [], []
    for text in binary_rows(batch, "text"):
        *base, by_line = measure(text)
        rows.append(base)
        digests.append(xxhash.xxh3_128_digest(text))
        lines.append([{"h": h, "w": w} for h, w in by_line.items()])
    base = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    arrays = [batch.column("doc_id"), batch.column("host"), *(pa.array(c) for c in base), pa.array(digests, pa.binary()), pa.array(lines, pa.list_(pa.struct([("h", pa.binary()), ("w", pa.int64())])))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "digest", "lines"])


def quality(docs: DataFrame, most_docs: int = 10, most_share: float = 0.01, least_left: float = 0.5) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, base figures, base_failed, kept, n_frequent_words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"))
    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, digest binary, lines array<struct<h: binary, w: long>>"
    rows = park(map_batches(rows, _measured, schema).withColumn("row", F.monotonically_increasing_id()), "quality-rows")

    different = rows.dropDuplicates(["host", "digest"])
    pages = different.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = different.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > most_docs)
    frequent = frequent.join(pages, "host").where(F.col("n") > F.col("pages") * most_share).select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lines = rows.select("row", "host", (F.col("row") % SALTS).cast("int").alias("salt"), F.inline("lines"))
    lost = lines.join(frequent, ["host", "h", "salt"]).groupBy("row").agg(F.sum("w").alias("lost"))

    base = rows.drop("digest", "lines", "host").join(lost, "row", "left").withColumn("n_frequent_words", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    whole = F.col("n_words") - F.col("n_frequent_words") >= F.col("n_words") * least_left
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & whole).alias("kept"), "n_frequent_words")
