"""Metrics over tokens and their parts, and taggers bound by what is annotated already."""

import random

from pyspark.sql import functions as F

from lexmill.operators import evaluation, tagging, training

FIELDS = evaluation.PART_FIELDS


def plain_feats(value):
    return dict(x.strip().split("=", 1) for x in (value or "").replace("_", "").split("|") if "=" in x)


def plain(rows):
    n, c = {}, {}

    def add(name, ok):
        n[name], c[name] = n.get(name, 0) + 1, c.get(name, 0) + ok

    clean = lambda x: "" if x in (None, "_") else x
    for met, form, p_form, gs, ps in rows:
        if met:
            add("tokenization", form == p_form)
        same = met and len(gs) == len(ps)
        for k, g in enumerate(gs):
            g = [clean(x) for x in g]
            p = [clean(x) for x in ps[k]] if same else [None] * 6
            for name, x, y in zip(FIELDS, g, p):
                if name == "feats" or x:
                    add(name, x == y)
            if same and (g[2] or p[2]):
                a, b = plain_feats(g[2]), plain_feats(p[2])
                add("feats_partial", not b if not a else bool(b) and b.items() <= a.items())
            elif not met and g[2]:
                add("feats_partial", False)
            if g[0] or g[2]:
                add("upos_feats", same and g[0] == p[0] and g[2] == p[2])
    return {name: (c[name], n[name]) for name in n}


def test_part_metrics(spark):
    rnd = random.Random(6)
    part = lambda: tuple(rnd.choice(x) for x in (["N", "V", "_", None], ["x", "_", ""], ["A=1", "A=1|B=2", "B=2", "_", "", None, "A=2"], ["l", "m", "_"], ["r", "_", None], ["e", ""]))
    rows = [(rnd.random() < 0.8, rnd.choice("ab"), rnd.choice("ab"), [part() for _ in range(rnd.choice([1, 1, 2]))], [part() for _ in range(rnd.choice([1, 1, 2]))]) for _ in range(800)]
    kind = f"array<struct<{','.join(f'{c}:string' for c in FIELDS)}>>"
    names = ", ".join(f"{s}{c} string" for s in ("", "pred_") for c in ("form", *FIELDS))
    flat = [(met, f, *(gs[0] if len(gs) == 1 else part()), pf, *(ps[0] if len(ps) == 1 else part()), gs if len(gs) > 1 else None, ps if len(ps) > 1 else []) for met, f, pf, gs, ps in rows]
    df = spark.createDataFrame(flat, f"aligned boolean, {names}, parts {kind}, pred_parts {kind}")
    got = {r.metric: (r.correct, r.total) for r in evaluation.part_metrics(df).collect()}
    assert got == plain(rows)
    none = {r.metric: (r.correct, r.total, r.accuracy) for r in evaluation.part_metrics(df.limit(0)).collect()}
    assert len(none) == 9 and set(none.values()) == {(0, 0, None)}


def test_features_in_part(spark):
    cases = [("", "", True), ("", "A=1", False), ("A=1", "", False), ("A=1|B=2", "B=2", True), ("A=1", "A=1|B=2", False), ("A=1", "A=2", False), ("A = 1 |B=2", "A=1", True), ("A=2|A=1", "A=1", True), ("A=1", "junk", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "g string, p string")
    assert [r.ok for r in df.select(evaluation.feats_match(F.col("g"), F.col("p")).alias("ok")).collect()] == [c[2] for c in cases]


def test_candidates_agree_with_all_that_is_given(spark):
    vocab = spark.createDataFrame([("saw", "see", "VERB", "VBD", "Tense=Past|Mood=Ind", 5), ("saw", "saw", "NOUN", "NN", "Number=Sing", 3), ("saw", "saw", "VERB", "VB", "_", 2)], "form string, lemma string, upos string, xpos string, feats string, cnt long")
    empty = "_"
    asked = {"any": (empty,) * 4, "upos": ("VERB", "VERB", empty, empty), "xpos": (empty, empty, "NN", empty), "feats": (empty, empty, empty, "Mood=Ind"), "none": ("NOUN", "NOUN", "VBD", empty), "loose": (empty, empty, "VB", "Mood=Imp")}
    got = {}
    for name, (tag, upos, xpos, feats) in asked.items():
        forms = spark.createDataFrame([("saw",)], "form string").withColumn("given", tagging.given_key(*map(F.lit, (tag, upos, xpos, feats))))
        rows = tagging.lattice(forms, vocab, training.endings(vocab), training.tag_types(vocab)).collect()
        got[name] = sorted((r.tag, r.xpos, r.source) for r in rows)
    assert got["any"] == [("NOUN", "NN", "exact"), ("VERB", "VB", "exact"), ("VERB", "VBD", "exact")]
    assert got["upos"] == [("VERB", "VB", "exact"), ("VERB", "VBD", "exact")] and got["xpos"] == [("NOUN", "NN", "exact")]
    # a candidate without features is bound by none
    assert got["feats"] == [("VERB", "VB", "exact"), ("VERB", "VBD", "exact")] and got["loose"] == [("VERB", "VB", "exact")]
    assert {x[2] for x in got["none"]} <= {"ending", "existing"} and {x[0] for x in got["none"]} == {"NOUN"}
