"""A stream gives what a batch gives; trees are drawn without crossing a parser's feet."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from lexmill import streaming
from lexmill.operators import tokens as tk
from lexmill.plans.fixtures import annotated
from lexmill.sources import trees


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"Word w{k % 3}. The end, {k}", "en") for k in range(40)], streaming.DOCUMENTS)
    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    stream = streaming.text_stream(spark, str(tmp_path / "docs"), files_per_batch=2)
    run = streaming.running_vocabulary(stream).writeStream.outputMode("complete").format("memory").queryName("vocabulary").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {r.form: r.n for r in tk.token_table(docs).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert {r.form: r.n for r in spark.table("vocabulary").collect()} == want


def test_trees(spark):
    rows = annotated(tk.token_table(spark.createDataFrame([(1, "A <b> & c.")], "doc_id long, text string")))
    drawing = trees.drawn(rows).first().drawing
    root = ET.fromstring(drawing)
    assert len([x for x in root if x.tag.endswith("path")]) == rows.count() - 1
    assert trees.arc_heights([0, 1, 2, 1]) == [0, 1, 1, 2]
    assert trees.arc_heights([1, 9]) == [0, 0]
    text = trees.drawn(rows, "latex").first().drawing
    assert "\\deproot{1}{root}" in text and "\\& c" in text
