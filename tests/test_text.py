"""Scalars on hand-written strings."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import kernels
from lexmill.functions import text as t


def one(spark, f, *values):
    kinds = ", ".join(f"c{k} string" for k in range(len(values)))
    return spark.createDataFrame([values], kinds).select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("it's o'clock", ["it's", "o'clock"]), ("a''b", ["a'", "'", "b"]), ("a'-b", ["a'", "-", "b"]), ("state-of-the-art", ["state-of-the-art"]), ("-x-", ["-", "x", "-"]),
        ("l’été", ["l", "’", "été"]), ("a\tb", ["a", "\t", "b"]), ("3.14 $5 a_b", ["3", ".", "14", "$", "5", "a", "_", "b"]), ("", []), (None, None),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, t.tokens, text) == tokens


def test_token_options(spark):
    assert one(spark, lambda c: t.tokens(c, contractions=False), "it's") == ["it", "'", "s"]
    assert one(spark, lambda c: t.tokens(c, hyphenated=False), "a-b") == ["a", "-", "b"]
    assert one(spark, lambda c: t.tokens(c, trailing_apostrophe=False), "dogs' x") == ["dogs", "'", "x"]


def test_sentences(spark):
    assert one(spark, t.sentences, "It is 3.14. Yes! No... Well") == ["It is 3.14.", "Yes!", "No...", "Well"]
    assert kernels.quoted_sentences_py('He said "No. Never." Then left.') == ['He said "No. Never."', "Then left."]
    assert kernels.quoted_sentences_py("3.14 is. a...b") == ["3.14 is.", "a...b"]
    assert one(spark, kernels.quoted_sentences, "A. B") == ["A.", "B"]


def test_normal_forms(spark):
    assert one(spark, kernels.normalized("NFD"), "é") == "é"
    with pytest.raises(ValueError):
        kernels.normalized("NFX")


def test_feats(spark):
    assert one(spark, t.feats_normal, "B=2|A=1|junk") == "A=1|B=2"
    assert one(spark, t.feats_normal, None) == "_"
    assert one(spark, t.feats_map, "A=1|B=2|A=3") == {"A": "3", "B": "2"}
    assert one(spark, t.feats_within, "A=1", "A=1|B=2") and one(spark, t.feats_within, "_", "A=1") and not one(spark, t.feats_within, "A=2", "A=1")
    assert tuple(one(spark, t.unimorph_to_ud, "V;IND;SG;3;PRS")) == ("VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Pres")
    assert tuple(one(spark, t.unimorph_to_ud, None)) == ("_", "_")


def test_small_scalars(spark):
    assert [one(spark, t.case_class, x) for x in ("USA", "Usa", "usa", "3", "A")] == ["UU", "Ul", "ll", "??", "Ul"]
    assert one(spark, t.align_key, "L'Été!") == "lété" and one(spark, t.align_key, "--") == "--"
    assert one(spark, t.form_escaped, "_") == "\\_" and one(spark, t.form_escaped, "") == "_" and one(spark, t.form_unescaped, "\\_") == "_"
    assert one(spark, t.rejoined, "exam-\nple x") == "example x"
    assert one(spark, t.language_of_path, "/a/en_ewt-ud-test.conllu") == "en" and one(spark, t.language_of_path, "x.txt") is None
    assert one(spark, t.whitespace_tokens, "Hi there... you.") == ["Hi", "there", "...", "you", "."]
    assert [one(spark, t.detected_format, x) for x in ("<TEI><tok>", "# sent_id = 1\n", "plain")] == ["teitok", "conllu", "raw"]


@pytest.mark.parametrize("word, lemma, rule", [("walked", "walk", "*ed#*"), ("went", "go", "went#go"), ("same", "same", "*#*"), ("Häuser", "Haus", None)])
def test_lemma_rules(spark, word, lemma, rule):
    got = one(spark, kernels.lemma_rule, word, lemma)
    assert rule is None or got == rule
    if rule in ("*ed#*", "*#*"):
        assert one(spark, kernels.apply_rule, word, got) == lemma
    assert kernels.apply_rule_py("jumped", "*ed#*") == "jump" and kernels.apply_rule_py("jump", "*ed#*") is None
