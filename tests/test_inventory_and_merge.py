"""Names of fields, and multiword tokens merged while annotation is taken off."""

from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import tokens as tk
from lexmill.operators import training


def test_field_names(spark):
    names = ["###sent_id", " Gloss[en]", "ptext(88)", "Field [x]y", "transl_ru-13", "a.b", "a--b__c", "x.7", "_y_", "ṣa", "", "[z]", "-3", "n2"]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(t.misc_name(F.col("n"))).collect()]
    assert got == ["sent_id", "Gloss", "ptext", "Field", "transl_ru", "a_b", "a_b_c", "x", "y", None, None, None, None, "n2"]


def test_field_inventory(spark):
    token = "1\tx\tx\tX\t_\t_\t0\troot\t_\t{}"
    lines = ["# newdoc id=a Genre=b", "# newpar id=p", "# sent_id = 1", "  # text[a9] = x = y  ", "# speaker_2=me", "# größe = 3", "# no value =", "# plain", token.format("SpaceAfter=No|Gloss[en]=a=b|bare|ṣa=1|=x"), token.format("_"), "1\tshort", "", None]
    got = {(r.field, r.name): r.cnt for r in training.field_inventory(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {("DOC", "id"): 1, ("DOC", "Genre"): 1, ("SENT", "sent_id"): 1, ("SENT", "text"): 1, ("SENT", "speaker"): 1, ("SENT", "größe"): 1, ("DOC", "größe"): 1, ("MISC", "SpaceAfter"): 1, ("MISC", "Gloss"): 1}


def test_multiword_tokens_merge(spark):
    forms = [("I", True), ("do", False), ("n't", True), ("go", True), ("d", False), ("el", None)]
    tokens = spark.createDataFrame([(1, 0, 0, k, f, "VERB", s, f"id{k}") for k, (f, s) in enumerate(forms)], "doc_id long, line_no int, sent_no int, tok_no int, form string, upos string, space_after boolean, tokid string")
    mwts = spark.createDataFrame([(1, 0, 0, 1, 2, "don't"), (1, 0, 0, 4, 5, "_"), (1, 0, 7, 0, 1, "none")], "doc_id long, line_no int, sent_no int, mwt_start int, mwt_end int, form string")
    got = sorted(tuple(r) for r in tk.merged_detagged(tokens, mwts).select("tok_no", "form", "upos", "space_after", "tokid").collect())
    assert got == [(0, "I", "_", True, "id0"), (1, "don't", "_", True, "id1"), (3, "go", "_", True, "id3"), (4, "del", "_", None, "id4")]
    assert tk.merged_detagged(tokens, mwts.limit(0)).count() == 6 and tk.merged_detagged(tokens.limit(0), mwts).isEmpty()
