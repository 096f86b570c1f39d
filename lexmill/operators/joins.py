"""Joins in which one key may hold a third of all rows.

What is hot is a number of rows, not a share: a task should get about `part` rows of one key, and that number
grows with the table from PART to LARGEST only. A hot key is dealt to as many parts as its rows ask for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import park

#: Rows of a hot key in one part: PART in small tables, 1/PARTS of all rows in larger ones, LARGEST at most.
PART, PARTS, LARGEST = 1_024, 4_096, 1 << 16
#: Where a part has PART rows, keys with more rows than this are hot; in larger tables as many times more as parts are larger.
LEAST_HOT = 4_096
#: Hot keys that are broadcast; more of them are a table in the shared folder that is joined.
FEW = 200_000


@dataclass
class Hot:
    """The hot keys of a column with their number of parts, `_hot`; None where there are none (then nothing is salted)."""

    key: str
    table: DataFrame | None
    few: bool = True

    @property
    def known(self) -> DataFrame:
        """The table as a side of a join: to broadcast if it has FEW rows at most; else the join's other side is split where it is skewed."""
        return F.broadcast(self.table) if self.few else self.table

    def dealt(self, many: DataFrame, row: str) -> DataFrame:
        """`many` with `_salt`: rows of a hot key are dealt to its parts by a hash of `row`, others have 0."""
        if self.table is None:
            return many.withColumn("_salt", F.lit(0))
        salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(row), F.col("_hot"))).cast("int")
        return many.join(self.known, self.key, "left").withColumn("_salt", salt).drop("_hot")

    def repeated(self, few: DataFrame) -> DataFrame:
        """`few` with `_salt`: rows of a hot key once for every salt."""
        if self.table is None:
            return few.withColumn("_salt", F.lit(0))
        return few.join(self.known, self.key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_hot"), F.lit(1)) - 1))).drop("_hot")


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> Hot:
    """The keys of counts(key, n) with more rows than a task should get. Two numbers come to the driver, and FEW keys at most."""
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    part = min(max(PART, (total or 0) // PARTS), LARGEST)
    least = LEAST_HOT * part // PART
    if (most or 0) <= least:
        return Hot(key, None)
    rows = counts.where(F.col(n) > least).select(key, F.greatest(F.lit(2), F.ceil(F.col(n) / part)).cast("int").alias("_hot"))
    found = rows.limit(FEW + 1).collect()
    if len(found) <= FEW:
        return Hot(key, counts.sparkSession.createDataFrame(found, rows.schema))
    return Hot(key, park(rows, "hot-keys"), few=False)


def salted_join(many: DataFrame, few: DataFrame, key: str, row: str, how: str = "inner", counted: str | None = None) -> DataFrame:
    """Join by `key`, where `few` has few rows per key. `row` is a column of `many` that spreads its rows.

    Hot keys are found by counting, or read off the column `counted` of `few`; counts are sums made before their shuffle.
    """
    counts = few.select(key, F.col(counted).alias("n")) if counted else many.groupBy(key).agg(F.count("*").alias("n"))
    hot = hot_keys(counts, key)
    return hot.dealt(many, row).join(hot.repeated(few), [key, "_salt"], how).drop("_salt")


def beside(rows: DataFrame, side: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Left join of `rows` with `side`, which has one row of a key at most: the rows of both are laid beside each other by key.

    Tables that are dealt by some of the keys (tokens by their document) stay where they are; a join would deal them anew by all keys.
    Columns as of a join by `keys`; a null key meets none.
    """
    own, new = ([c for c in x.columns if c not in keys] for x in (rows, side))
    # columns stay apart, so that those nobody asks for are not carried along
    none = lambda x, names: [F.lit(None).cast(x.schema[c].dataType).alias(c) for c in names]
    cols = lambda names: [F.col(f"`{c}`") for c in names]
    left = rows.select(*keys, F.lit(True).alias("_asks"), *cols(own), *none(side, new))
    right = side.dropna(subset=list(keys)).select(*keys, F.lit(False).alias("_asks"), *none(rows, own), *cols(new))
    w = Window.partitionBy(*keys)
    return left.unionByName(right).withColumns({c: F.first(f"`{c}`", ignorenulls=True).over(w) for c in new}).where("_asks").drop("_asks")
