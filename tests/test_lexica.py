"""Lexica, tagsets, regular forms, ids and names on small tables."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import language, lexicon, reports
from lexmill.operators import tokens as tk
from lexmill.plans.more import TAGSET_XML
from lexmill.sources import conllu


def test_tagset(spark, tmp_path):
    (tmp_path / "tagset.xml").write_text(TAGSET_XML)
    tagset = lexicon.read_tagset(spark, str(tmp_path))
    tags = spark.createDataFrame([(x,) for x in ["NMS", "NPFP", "N0P", "VSF", "RG", "Q", "_", "N"]], "xpos string")
    got = {r.xpos: (r.upos, r.feats) for r in lexicon.positional_tags(tags, tagset).collect()}
    assert got == {"NMS": ("NOUN", "Gender=Masc|Number=Sing"), "NPFP": ("PROPN", "Gender=Fem|Number=Plur"), "N0P": ("NOUN", "Number=Plur"), "VSF": ("VERB", "Mood=Sub|Tense=Fut"), "RG": ("ADV", "_"), "Q": ("X", "_"), "_": ("_", "_"), "N": ("NOUN", "_")}
    with pytest.raises(ValueError, match="positions"):
        lexicon.tagset_rows("<tagset/>")


def test_regular_forms(spark):
    regs = spark.createDataFrame([("coracon", "corazón"), ("vezes", "veces"), ("corazon", "corazón"), ("Casa", "casa"), ("fazer", "hacer"), ("de", "dé"), (";", ","), ("xyz", "nowhere"), ("muger", "mujer")], "form string, reg string")
    vocab = spark.createDataFrame([("corazon", 2), ("corazón", 9), ("veces", 5), ("vezes", 3), ("casa", 4), ("Casa", 1), ("fazer", 1), ("hacer", 1), ("de", 500), ("dé", 20), (",", 9), (";", 9), ("muger", 1), ("mujer", 1), ("mujeres", 2), ("cancion", 1), ("póco", 1), ("poco", 3)], "form string, cnt long")
    suffixes = spark.createDataFrame([("es", 9), ("s", 5)], "suffix string, cnt long")
    replaced = spark.createDataFrame([("ç", "c", 30), ("ó", "o", 20), ("é", "e", 10)], "old string, new string, cnt long")
    words = ["corazon", "Vezes", "corazón", "Casa", "fazer", "de", ";", "xyz", "mugeres", "cançion", "coraçón", "póço", "zzz"]
    got = {r.form: (r.reg, r.how) for r in lexicon.regular_forms(spark.createDataFrame([(w,) for w in words], "form string"), regs, vocab, suffixes, replaced).collect()}
    # each replacement must lead to a known word: so póço goes two steps and coraçón none
    assert got == {"corazon": ("corazón", "explicit"), "Vezes": ("veces", "explicit"), "corazón": ("corazón", "same"), "Casa": ("Casa", "same"), "fazer": ("hacer", "explicit"), "de": ("de", "same"), ";": (";", "same"), "xyz": ("nowhere", "explicit"), "mugeres": ("mujeres", "morphology"), "cançion": ("cancion", "substitution"), "coraçón": ("coraçón", "same"), "póço": ("poco", "substitution"), "zzz": ("zzz", "same")}


def test_language_names(spark):
    listed = spark.createDataFrame([("en", "eng", "English"), ("es", "spa", "Spanish"), (None, "swh", "Swahili"), ("fr", "fra", "Français")], "iso1 string, iso3 string, name string")
    queries = ["EN", "spa", "swh", "francais", "Englich", "xx", "", None, "qqqqqq"]
    got = {r.q: (r.iso, r.how) for r in language.resolved(spark.createDataFrame([(q,) for q in queries], "q string"), listed).collect()}
    assert got == {"EN": ("en", "code"), "spa": ("es", "code"), "swh": ("swh", "code"), "francais": ("fr", "name"), "Englich": ("en", "fuzzy"), "xx": (None, "none"), "": (None, "none"), None: (None, "none"), "qqqqqq": (None, "none")}


def test_ids_and_references(spark):
    rows = lambda xs: spark.createDataFrame(xs, "doc_id long, sent_id string, sent_no int, tok_no int, tokid string")
    source = rows([(1, "a", 0, 0, "w1"), (1, "a", 0, 1, "w2"), (1, None, 1, 0, "w3"), (1, "b", 2, 0, "w4")])
    target = rows([(1, "b", 0, 0, None), (1, "x", 1, 0, ""), (1, "a", 2, 0, "own"), (1, "a", 2, 1, None), (1, "a", 2, 2, None)])
    assert [r.tokid for r in tk.with_ids_of(target, source).orderBy("sent_no", "tok_no").collect()] == ["w4", "w3", "own", "w2", None]
    sentences = spark.createDataFrame([(1, 7, "#w2 #w4")], "doc_id long, sent_no int, corresp string")
    assert sorted((r.tokid, r.sent_no, r.tok_no) for r in tk.referenced(source, sentences).collect()) == [("w1", 0, 0), ("w2", 7, 0), ("w3", 1, 0), ("w4", 7, 1)]


def test_misc_of_the_writer(spark):
    row = (1, 0, 0, "a", "x=y", "B-PER", "PER_1", False)
    df = spark.createDataFrame([(*row[:3], 0, row[3], row[4], row[5], row[6], "t9", row[7], 1, 2, "ab"), (1, 0, 0, 1, "b", "_", None, None, "s1-t2", None, 1, 2, "ab")], "doc_id long, line_no int, sent_no int, tok_no int, form string, misc string, entity string, ne string, tokid string, space_after boolean, mwt_start int, mwt_end int, mwt_form string")
    df = df.withColumns({c: F.lit("_") for c in ("lemma", "upos", "xpos", "feats", "deprel")}).withColumn("head", F.lit(0))
    got = conllu.sentence_bodies(df).first()
    lines = [x.split("\t") for x in got.body.split("\n")]
    assert got.text == "ab" and [x[0] for x in lines] == ["1-2", "1", "2"] and lines[0][1] == "ab"
    assert lines[1][9] == "x=y|Entity=B-PER|NE=PER_1|TokId=t9|SpaceAfter=No" and lines[2][9] == "_"


def test_small_functions(spark):
    one = lambda *cols: tuple(spark.range(1).select(*cols).first())
    assert one(t.misc_name(F.lit(" Gloss[en]")), t.misc_name(F.lit("Ref_12")), t.only_case_differs(F.lit("A"), F.lit("a")), t.only_case_differs(F.lit("a"), F.lit("a"))) == ("Gloss", "Ref", True, False)
    assert one(t.tokens_per_second(F.lit(10), F.lit(4.0)), t.tokens_per_second(F.lit(10), F.lit(0.0))) == (2.5, None)
    shares = one(t.softmax(F.array(*(F.lit(float(k)) for k in range(12)))))[0]
    assert len(shares) == 10 and abs(sum(shares) - 1) < 1e-12 and shares == sorted(shares, reverse=True)
    assert one(t.model_rating(F.lit("en_core_web_lg"))["accuracy"], t.model_rating(F.lit("en_sm"))["speed"]) == (3, 3)
    assert one(t.tag_of("utot", F.lit("NOUN"), F.lit("N"), F.lit("A=B")), t.tag_of("utot", F.lit("NOUN"), F.lit("N"), F.lit("_"))) == ("NOUN#A=B", "NOUN")
    names = spark.createDataFrame([(x,) for x in ["b10", "B9", "b", "a02x1", None]], "x string")
    assert [r.x for r in names.orderBy(reports.natural_key(F.col("x"))).collect()] == [None, "a02x1", "b", "B9", "b10"]


@pytest.mark.parametrize(("data", "want"), [(b"\xef\xbb\xbf\xc3\xa9", ("UTF-8-SIG", "é")), ("né".encode("utf-16"), ("UTF-16LE", "né")), ("né".encode(), ("UTF-8", "né")), ("né".encode("latin-1"), ("ISO-8859-1", "né"))])
def test_encodings(spark, data, want):
    df = spark.createDataFrame([(bytearray(data),)], "data binary")
    assert tuple(df.select(t.decoded(F.col("data")).alias("x")).select("x.*").first()) == want
