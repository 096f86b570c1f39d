"""Hard negatives of anchors: for each anchor and each of its best rows of the same label, the best rows of other labels within a window of scores.

Vectors are whole numbers, floor(256 x), and scores their inner products. Every row is kept with its product
quantisation (per `width` components one of 256 whole-number centroids) and the length of what that leaves
over, rounded up. A row's score with an anchor is then that of its centroids, read off the anchor's lookup
tables, plus or minus |anchor| * leftover (Cauchy-Schwarz): rows whose interval misses what an anchor still looks for
are dropped, all others are scored exactly. Nothing is lost by the index, however badly it fits the data.

Two searches over all rows: the best `n_positives` of the same label, then for each of them the best
`n_negatives` of other labels with low * positive <= 100 * score <= high * positive. Anchors go in waves of at
most about `wave`, whose vectors and tables each task holds; the rows stay where they lie and are read
in blocks, so no pair of blocks is ever shuffled, only the best few of each anchor and partition.

Bounds: the centroids are fitted on the SAMPLE rows of smallest hash; the driver holds that sample, and a wave's anchors and
positives. Rows of one label, copies of a vector: they only meet as scores, and each anchor keeps its best few.

Defined cases: rows with a null label, vector or vec_id, or with a null or non-finite component, take no part,
nor do rows whose number of components is not the most frequent one (of equally frequent ones the smallest). Equal scores
go by vec_id. Repeated rows each count; repeated anchors give repeated results. An anchor without another row of
its label, or without a row in a window, has no row in the result. An empty table gives an empty result. Columns besides
vec_id, embedding and label are not read. Components must leave scores within 62 bits, else the operator raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import park, shared_dir

#: Rows that centroids are fitted on, centroids of a part, and turns of fitting.
SAMPLE, CENTROIDS, TURNS = 4_096, 256, 8
#: Rows and anchors in a block of scores, and pairs scored exactly at once.
ROWS, ANCHORS, PAIRS = 1_024, 128, 1 << 16
NONE = np.iinfo(np.int64).min


@dataclass
class Quantiser:
    """Centroids (part, centroid, component) of whole numbers; vectors are padded with zeros to whole parts."""

    width: int
    centroids: np.ndarray

    def parts(self, v: np.ndarray) -> np.ndarray:
        """(rows, components) -> (part, row, component)."""
        n_parts = len(self.centroids)
        wide = np.zeros((len(v), n_parts * self.width), dtype=v.dtype)
        wide[:, : v.shape[1]] = v
        return wide.reshape(len(v), n_parts, self.width).transpose(1, 0, 2)

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row, part) and the length of the rest of each row, rounded up."""
        codes, rest = np.zeros((len(v), len(self.centroids)), dtype=np.uint8), np.zeros(len(v))
        for m, own in enumerate(self.parts(v)):
            codes[:, m] = nearest(own.astype(float), self.centroids[m].astype(float))
            rest += ((own - self.centroids[m][codes[:, m]]).astype(float) ** 2).sum(1)
        return codes, np.sqrt(rest) * (1 + 1e-9)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """Scores (part, centroid, anchor) of the centroids with the anchors' parts."""
        return np.einsum("mkw,maw->mka", self.centroids, self.parts(anchors))


def nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * v @ centroids.T).argmin(1)


def fitted(sample: np.ndarray, width: int) -> Quantiser:
    """k-means of each part over the sample; empty cells keep their centroid."""
    n_parts = -(-sample.shape[1] // width)
    out = Quantiser(width, np.zeros((n_parts, 1, width), dtype=np.int64))
    if not len(sample):
        return out
    found = np.zeros((n_parts, CENTROIDS, width), dtype=np.int64)
    for m, own in enumerate(out.parts(sample)):
        points = np.unique(own, axis=0).astype(float)
        centroids = points[np.linspace(0, len(points) - 1, CENTROIDS).astype(int)]
        for _ in range(TURNS):
            at = nearest(own.astype(float), centroids)
            n = np.bincount(at, minlength=CENTROIDS)
            for k in range(width):
                sums = np.bincount(at, own[:, k].astype(float), minlength=CENTROIDS)
                centroids[:, k] = np.where(n, sums / np.maximum(n, 1), centroids[:, k])
        found[m] = np.rint(centroids)
    return Quantiser(width, found)


@dataclass
class Best:
    """The best `k` finds of each slot: higher score, then smaller vec_id."""

    k: int
    least: np.ndarray  # of each slot, the score that a find must reach
    slot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    vec_id: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    row: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, vec_id, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec_id, vec_id), (self.row, row)))
        order = np.lexsort((row, vec_id, -score, slot))
        starts = np.searchsorted(slot[order], slot[order])
        rank = np.arange(len(order)) - starts
        kept = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        self.slot, self.score, self.vec_id, self.row = slot[kept], score[kept], vec_id[kept], row[kept]


@dataclass
class Wave:
    """The anchors of a wave. Slots: `n_slots` windows [low, high] of each anchor; same: of its own label or of others."""

    quantiser: Quantiser
    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of these rows for each slot: anchor (its row), slot, score, vec_id, row."""
        blocks = [slice(s, s + ANCHORS) for s in range(0, len(self.row), ANCHORS)]
        tables = [_narrow(self.quantiser.tables(self.vectors[b])) for b in blocks]
        norms = np.sqrt((self.vectors.astype(float) ** 2).sum(1)) * (1 + 1e-9)
        best = [Best(self.k, self.low[b].ravel().copy()) for b in blocks]
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                rows = _decoded(batch.slice(s, ROWS), self.vectors.shape[1], len(self.quantiser.centroids))
                for b, table, own in zip(blocks, tables, best, strict=True):
                    self._block(b, table, norms[b], own, *rows)
        n_slots = self.low.shape[1]
        for b, own in zip(blocks, best, strict=True):
            if len(own.slot):
                columns = [self.row[b][own.slot // n_slots], own.slot % n_slots, own.score, own.vec_id, own.row]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "score", "vec_id", "row"])

    def _block(self, b: slice, table: np.ndarray, norms: np.ndarray, best: Best, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, vectors: np.ndarray, codes: np.ndarray, rest: np.ndarray) -> None:
        n_slots = self.low.shape[1]
        least, high = best.least.reshape(-1, n_slots), self.high[b]
        about = np.zeros((len(row), len(norms)), dtype=table.dtype)
        for m, own in enumerate(table):
            about += own[codes[:, m]]
        spread = np.outer(rest, norms) + 1
        # an open slot's window isn't empty; closed ones are out of reach
        is_open = least <= high
        lowest, highest = np.where(is_open, least, np.iinfo(np.int64).max).min(1), np.where(is_open, high, NONE).max(1)
        may = (about + spread >= lowest) & (about - spread <= highest)
        may &= (label[:, None] == self.label[b]) == self.same
        if self.same:
            may &= row[:, None] != self.row[b]
        at, anchor = np.nonzero(may)
        for s in range(0, len(at), PAIRS):
            i, a = at[s : s + PAIRS], anchor[s : s + PAIRS]
            score = np.einsum("ij,ij->i", vectors[i], self.vectors[b][a])
            for slot in range(n_slots):
                fits = (score >= best.least.reshape(-1, n_slots)[a, slot]) & (score <= high[a, slot])
                best.add(a[fits] * n_slots + slot, score[fits], vec_id[i[fits]], row[i[fits]])


def _narrow(table: np.ndarray) -> np.ndarray:
    """Tables in half the memory, where no sum over the parts can leave 32 bits."""
    return table.astype(np.int32) if table.size and np.abs(table).max((1, 2)).sum() < 1 << 31 else table


def _matrix(column: pa.Array, n: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), n)


def _decoded(batch: pa.RecordBatch, dim: int, n_parts: int) -> tuple[np.ndarray, ...]:
    row, vec_id, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
    return row, vec_id, label, _matrix(batch.column("vector"), dim, "<i8"), _matrix(batch.column("codes"), n_parts, "u1"), batch.column("rest").to_numpy()


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (floor(256 x) of each component) of the rows that take part, whatever their length."""
    sound = F.forall("embedding", lambda x: F.abs(x.cast("double")) < F.lit(float("inf")))
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("v")
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v)


def indexed(rows: DataFrame, width: int = 2) -> tuple[DataFrame, Quantiser, int]:
    """The table of rows(vec_id, label, v) with codes and rests, its quantiser and the number of components."""
    size, largest = F.size("v"), F.max(F.array_max(F.transform("v", F.abs)))
    most = rows.groupBy(size.alias("dim")).agg(F.count("*").alias("n"), largest.alias("largest")).orderBy(F.desc("n"), "dim").first()
    dim = most.dim if most else 0
    if dim and dim * (most.largest + 1) ** 2 >= 1 << 60:
        raise ValueError(f"components up to {most.largest} make scores too large")
    rows = rows.where(size == dim)
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect()
    quantiser = fitted(np.array([r.v for r in sample], dtype=np.int64).reshape(len(sample), dim), width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            codes, rest = quantiser.codes(v)
            blobs = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (v.astype("<i8"), codes)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *blobs, pa.array(rest)], names=["vec_id", "label", "vector", "codes", "rest"])

    table = rows.mapInArrow(coded, "vec_id long, label long, vector binary, codes binary, rest double")
    return park(table.select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows"), quantiser, dim


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, width: int = 2, wave: int = 1_024) -> DataFrame:
    """vectors(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: vec_id divisible by `every`."""
    spark = vectors.sparkSession
    rows, quantiser, dim = indexed(whole_numbers(vectors), width)
    anchors = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "vector")
    n_waves = -(-anchors.count() // wave)
    path = f"{shared_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    finds = "anchor long, slot long, score long, vec_id long, row long"
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    for k in range(n_waves):
        own = sorted(anchors.where(F.pmod(F.xxhash64("row"), F.lit(n_waves)) == k).collect())
        if not own:
            continue
        at = {r.row: i for i, r in enumerate(own)}
        every_slot = np.zeros((len(own), 1), dtype=np.int64)
        first = Wave(quantiser, np.array([r.row for r in own]), np.array([r.label for r in own]), np.stack([np.frombuffer(r.vector, "<i8") for r in own]).reshape(len(own), dim), every_slot - (1 << 62), every_slot + (1 << 62), True, n_positives)
        positives = rows.mapInArrow(first.search, finds).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_positives).select("anchor", "rank", "score", "vec_id").collect()
        # windows that hold nothing have their ends crossed
        lows, highs = np.full((len(own), n_positives), 1 << 61), np.full((len(own), n_positives), -(1 << 61))
        for p in positives:
            lows[at[p.anchor], p.rank - 1], highs[at[p.anchor], p.rank - 1] = -(-low * p.score // 100), high * p.score // 100
        second = Wave(quantiser, first.row, first.label, first.vectors, lows, highs, False, n_negatives)
        ranked = rows.mapInArrow(second.search, finds).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
        names = {r.row: r.vec_id for r in own}
        known = spark.createDataFrame([(p.anchor, p.rank - 1, names[p.anchor], p.vec_id, p.score) for p in positives], "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
        found = ranked.join(F.broadcast(known), ["anchor", "slot"])  # at most n_positives rows an anchor of the wave
        found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
