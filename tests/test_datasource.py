"""format("conllu") and format("teitok"), both ways."""

import os

import pytest
from pyspark.sql import functions as F

from lexmill.operators import tokens as tk
from lexmill.plans.fixtures import annotated
from lexmill.sources import conllu, datasource, registry, teitok

TEXT = 'Anna\'s cat sat. The "well-known" dog (Rex) ran & hid.\n\nLast line _ here'


@pytest.fixture(scope="module")
def tokens(spark):
    datasource.register(spark)
    docs = spark.createDataFrame([(k, TEXT * (1 + k % 3)) for k in range(12)], "doc_id long, text string")
    return tk.with_space_after(annotated(tk.token_table(docs)))


def rows(df, *without):
    return sorted(map(repr, df.select(*sorted(set(df.columns) - set(without))).collect()))


def test_conllu_both_ways(spark, tokens, tmp_path):
    texts = conllu.documents(tokens)
    texts.repartition(4).write.format("conllu").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{k}.conllu" for k in range(12))
    got = spark.read.format("conllu").option("partitionBytes", 6_000).load(f"file://{tmp_path}/out")
    want = conllu.parsed(texts).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert set(got.columns) == set(want.columns) and rows(got) == rows(want)
    assert 1 < got.rdd.getNumPartitions() < 12
    one = spark.read.format("conllu").load(str(tmp_path / "out" / "3.conllu"))
    assert one.select("doc_id").distinct().collect() == [("3",)]


def test_conllu_as_files_have_it(spark, tmp_path):
    datasource.register(spark)
    row = lambda i, f, h="0", m="_": "\t".join([i, f, "_", "X", "_", "_", h, "dep", "_", m])
    text = "# newdoc id = d\r\n# sent_id = a\r\n" + "\n".join([row("1-2", "del"), row("1", "de"), row("2", "el", "_"), row("2.1", "e"), "bad\trow", row("3", "\\_", "x", "A=b|SpaceAfter=No")]) + "\n \n\n# newpar id = p\n" + row("1", "x")
    (tmp_path / "in" / "_hidden").mkdir(parents=True)
    (tmp_path / "in" / "f.conllu").write_text(text, newline="")
    (tmp_path / "in" / "_hidden" / "g.conllu").write_text(text)
    (tmp_path / "in" / "empty.conllu").write_text("")
    got = spark.read.format("conllu").load(str(tmp_path / "in"))
    want = conllu.parsed(spark.createDataFrame([("f", text)], "doc_id string, conllu string"))
    assert rows(got) == rows(want) and got.count() == 4
    (tmp_path / "none").mkdir()
    assert spark.read.format("conllu").load(str(tmp_path / "none")).count() == 0


def test_teitok_both_ways(spark, tokens, tmp_path):
    texts = teitok.documents(tokens)
    texts.write.format("teitok").mode("overwrite").save(str(tmp_path / "xml"))
    got = spark.read.format("teitok").load(str(tmp_path / "xml"))
    assert rows(got) == rows(teitok.parsed(texts).withColumn("doc_id", F.col("doc_id").cast("string")))
    (tmp_path / "xml" / "0.xml").write_text('<TEI><s id="1"><tok id="w1" pos="N">a</tok></s></TEI>')
    named = spark.read.format("teitok").option("names.upos", "upos,pos").load(str(tmp_path / "xml"))
    assert [r.upos for r in named.where("doc_id = '0'").collect()] == ["N"]


def test_nothing_is_left_of_a_failed_write(spark, tokens, tmp_path):
    texts = conllu.documents(tokens).select("doc_id", "conllu")
    texts.write.format("conllu").mode("append").save(str(tmp_path / "out"))
    # overwriting takes the old files away, and only at the end
    texts.where("doc_id < 2").write.format("conllu").mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["0.conllu", "1.conllu"]
    with pytest.raises(Exception, match="file name of another"):
        texts.select(F.lit("same"), "conllu").write.format("conllu").mode("overwrite").save(str(tmp_path / "out"))
    with pytest.raises(Exception):
        texts.select("doc_id", F.when(F.col("doc_id") > 5, F.raise_error(F.lit("lost"))).otherwise(F.col("conllu"))).write.format("conllu").mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["0.conllu", "1.conllu"]
    with pytest.raises(Exception, match="two columns"):
        tokens.write.format("conllu").mode("append").save(str(tmp_path / "out"))


def test_plugged_in_annotators_are_found(spark, monkeypatch):
    from importlib import metadata

    class Point:
        name = "shout"

        def load(self):
            return lambda df: df.withColumn("form", F.upper("form"))

    monkeypatch.setattr(metadata, "entry_points", lambda group: [Point()] if group == registry.GROUP else [])
    assert registry.discover() == ["shout"]
    got = registry.annotators.get("shout")(spark.createDataFrame([("a",)], "form string"))
    assert got.collect() == [("A",)]
    assert registry.discover() == []
