"""Hot keys are split by their rows, whatever their share."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import joins


def test_a_key_of_a_million_rows_takes_as_many_parts_as_it_asks_for(spark):
    n = 1_000_000
    many = spark.range(3 * n).select("id", F.when(F.col("id") < n, F.lit(-1)).otherwise(F.col("id") % 500_000).cast("long").alias("k"))
    few = many.groupBy("k").agg(F.max("id").alias("top"))
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    hot = joins.hot_keys(counts, "k")
    assert [tuple(r) for r in hot.table.collect()] == [(-1, -(-n // joins.PART))]
    dealt = hot.dealt(many, "id").where("k = -1").groupBy("_salt").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    assert dealt[0] == -(-n // joins.PART) and dealt[1] < 2 * joins.PART
    got = joins.salted_join(many, few, "k", "id")
    assert got.agg(F.count("*"), F.sum("id"), F.sum("top")).first() == many.join(few, "k").agg(F.count("*"), F.sum("id"), F.sum("top")).first()


@pytest.mark.parametrize("few", [200_000, 3])
def test_more_hot_keys_than_are_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "LEAST_HOT", 10)
    monkeypatch.setattr(joins, "FEW", few)
    many = spark.range(4_000).select("id", (F.col("id") % 20).alias("k"))
    hot = joins.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert hot.few == (few > 3) and hot.table.count() == 20
    side = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got, want = joins.salted_join(many, side, "k", "id", how), many.join(side, "k", how)
        assert sorted(map(repr, got.select("id", "k", "v").collect())) == sorted(map(repr, want.select("id", "k", "v").collect()))


def test_parts_follow_the_table(spark):
    counts = lambda *ns: spark.createDataFrame(list(enumerate(ns)), "k long, n long")
    assert joins.hot_keys(counts(4_096, 10), "k").table is None and joins.hot_keys(counts(), "k").table is None
    assert joins.hot_keys(counts(10**12, 10**5, 300_000), "k").table.collect() == [(0, -(-(10**12) // joins.LARGEST)), (2, 5)]
