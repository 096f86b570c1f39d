"""Commands and XML editing on small files."""

import pytest
from pyspark.sql import functions as F

from lexmill import commands
from lexmill.operators import model
from lexmill.operators import tokens as tk
from lexmill.plans.fixtures import annotated
from lexmill.sources import conllu, teitok

TEXT = "The cat sat on the mat. A dog barked, and the cats ran away.\nThe mat was red."


@pytest.fixture(scope="module")
def gold(spark):
    return tk.with_space_after(annotated(tk.token_table(spark.createDataFrame([("d", TEXT)], "doc_id string, text string"))))


def test_commands(spark, gold, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "d.txt").write_text(TEXT)
    commands.train(gold, str(tmp_path / "model"))
    m = model.load(spark, str(tmp_path / "model"))
    raw = commands.tokens_of(spark, str(tmp_path / "raw"), "raw")
    done = commands.process(raw, m)
    assert done.columns == raw.columns and done.count() == gold.count() and done.where("upos = '_' or lemma = '_'").count() == 0
    assert commands.process(raw, m, ("lemmatize",)).where("upos <> '_'").count() == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.conllu").write_text(commands.convert(done, "conllu").first().conllu)
    again = commands.tokens_of(spark, str(tmp_path / "c"), "conllu")
    assert sorted((r.form, r.lemma, r.upos) for r in again.collect()) == sorted((r.form, r.lemma, r.upos) for r in done.collect())
    for mode in commands.MODES:
        got = {r.metric: r for r in commands.evaluate(gold, m, mode).collect()}
        assert got["tokenization"].correct == got["tokenization"].total == gold.count() and got["upos"].accuracy > 0.8
    with pytest.raises(ValueError, match="mode"):
        commands.evaluate(gold, m, "other")
    mapped = commands.map_tags(gold.withColumn("upos", F.lit("_")), gold, "upos-feats")
    assert mapped.where("upos = '_'").count() == 0


def test_dumps(gold):
    assert conllu.dumped(gold, "plain").first().text == TEXT.replace(". A", ".\nA")
    assert conllu.dumped(gold, "tokenized").first().text.startswith("The cat sat on the mat .\nA dog barked , and")
    assert "\tThe\t_\t_\t_\t_\t_\t_\t_\t_" in conllu.dumped(gold, "detagged").first().text


def test_names_are_wrapped(spark, gold):
    entities = spark.createDataFrame([("d", 0, 0, 2, 3, "A&B"), ("d", 0, 0, 3, 5, "X"), ("d", 1, 0, 1, 1, "Y")], "doc_id string, line_no int, sent_no int, first int, last int, label string")
    xml = teitok.documents(gold, entities).first().xml
    assert '<name type="A&amp;B"><tok id="w-1-1-2"' in xml and "X" not in xml.replace("TEI", "") and xml.count("</name>") == 2
    named = {r.form: r.entity for r in teitok.parsed(teitok.documents(gold, entities)).where("entity is not null").collect()}
    assert named == {"cat": "A&B", "sat": "A&B", "The": "Y"}


def test_files_are_updated_in_place(spark):
    xml = '<TEI><!-- keep --><s><tok id="w1" lemma="old">cat</tok>  <tok id="w2"><hi>d</hi>og</tok> <tok id="w3">x</tok></s></TEI>'
    files = spark.createDataFrame([(1, xml), (2, "<TEI/>"), (3, None)], "doc_id long, xml string")
    rows = spark.createDataFrame([(1, "w1", "cat", 'a"b'), (1, "w2", "dog", "dog"), (1, "w3", "other", "no")], "doc_id long, tokid string, form string, lemma string")
    got = {r.doc_id: r.xml for r in teitok.updated(files, rows).collect()}
    assert got == {1: xml.replace('lemma="old"', 'lemma="a&quot;b"').replace('id="w2"', 'id="w2" lemma="dog"'), 2: "<TEI/>", 3: None}


def test_tokens_are_inserted(spark):
    files = spark.createDataFrame([(1, "<p>a &amp; <hi>bc</hi>d e</p>")], "doc_id long, xml string")
    rows = spark.createDataFrame([(1, "t1", 0, 1), (1, "t2", 2, 3), (1, "t3", 4, 7), (1, "t4", 8, 9)], "doc_id long, tokid string, char_start int, char_end int")
    assert teitok.inserted(files, rows).first().xml == '<p><tok id="t1">a</tok> <tok id="t2">&amp;</tok> <hi>bc</hi>d <tok id="t4">e</tok></p>'


def test_settings_and_corpus(spark, tmp_path):
    assert teitok.attribute_names('<ttsettings><xmlfile><item key="msd" ud="xpos"/><item key="pos" ud="xpos"/><item key="x"/></xmlfile></ttsettings>') == {"xpos": ("msd", "pos")}
    (tmp_path / "a.xml").write_text('<TEI><s><tok id="w1" upos="X">a</tok></s><s><tok id="w2">b</tok></s></TEI>')
    assert [r.form for r in teitok.corpus(spark, str(tmp_path)).collect()] == ["a"]
