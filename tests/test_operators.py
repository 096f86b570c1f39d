"""Operators on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import blocks, evaluation, model, reports, tagging, training
from lexmill.operators import tokens as tk
from lexmill.plans.fixtures import annotated
from lexmill.sources import conllu, registry, teitok

TEXT = "Anna's cat sat. The well-known dog (Rex) ran, didn't he?\n\nLast line _ here"


def table(spark, *texts):
    return spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")


def test_offsets_point_at_forms(spark):
    docs = table(spark, TEXT)
    sentences = {(r.line_no, r.sent_no): r.sent for r in tk.sentence_table(docs).collect()}
    for r in tk.located(tk.token_table(docs), tk.sentence_table(docs)).collect():
        assert sentences[r.line_no, r.sent_no][r.char_start :].startswith(r.form)
    rebuilt = {(r.line_no, r.sent_no): r.text for r in tk.rebuilt(tk.with_space_after(tk.token_table(docs))).collect()}
    for r in tk.with_offsets(tk.with_space_after(tk.token_table(docs))).collect():
        assert rebuilt[r.line_no, r.sent_no][r.char_start : r.char_end] == r.form


def words(spark, *forms, glued=()):
    rows = [(0, 0, 0, k, f, "PUNCT" if f in "-'." else "X", False if k in glued else None) for k, f in enumerate(forms)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, sent_no int, tok_no int, form string, upos string, space_after boolean")


def test_multiword_tokens(spark):
    got = lambda *f, glued: [(r.mwt_start, r.mwt_end, r.form) for r in tk.implicit_mwts(words(spark, *f, glued=glued)).collect()]
    assert got("set", "-", "up", "now", glued=(0, 1)) == [(0, 2, "set-up")]
    assert got("do", "nt", ".", glued=(0, 1)) == []
    assert got("vamo", "nos", "x", glued=(0,)) == [(0, 1, "vamonos")]
    assert got(".", "a", "b", glued=(0, 1)) == [(1, 2, "ab")]
    pairs = [(r.first, r.second, r.form) for r in tk.contraction_pairs(words(spark, "a", "b", "c", "d", glued=(0, 1, 2))).orderBy("first").collect()]
    assert pairs == [(0, 1, "ab"), (2, 3, "cd")]


def test_conllu_round_trip(spark):
    tokens = tk.with_space_after(annotated(tk.token_table(table(spark, TEXT, "_ x"))))
    text = conllu.documents(tokens)
    back = conllu.parsed(text)
    key = lambda rows: sorted((r.doc_id, r.form, r.upos, r.feats, int(r.head), r.deprel) for r in rows)
    assert key(tokens.collect()) == key(back.collect())
    assert conllu.problems(back).count() == 0
    first = text.orderBy("doc_id").first().conllu
    assert first.startswith("# newdoc id = 0\n# newpar id = p1\n# sent_id = s1-1\n# text = ") and "SpaceAfter=No" not in first.split("\n")[3]


def test_conllu_reads_ranges_and_skips_bad_rows(spark):
    row = lambda i, f, h="0", m="_": "\t".join([i, f, "_", "X", "_", "_", h, "dep", "_", m])
    text = "# newdoc id = d\n# sent_id = a\n" + "\n".join([row("1-2", "del"), row("1", "de"), row("2", "el", "_"), row("2.1", "e"), "bad\trow", row("3", "\\_", "2", "SpaceAfter=No")]) + "\n\n# newdoc id = e\n" + row("1", "x") + "\n"
    got = conllu.parsed(spark.createDataFrame([(1, text)], "doc_id long, conllu string")).orderBy("sent_no", "row_no").collect()
    assert [(r.newdoc, r.form, r.head, r.mwt_form, r.space_after) for r in got] == [("d", "de", 0, "del", None), ("d", "el", 0, "del", None), ("d", "_", 2, None, False), ("e", "x", 0, None, None)]


def test_teitok(spark):
    xml = '<TEI><s id="s1"><name type="PER"><tok id="w1" lemma="a&amp;b" pos="N">A</tok></name> <tok id="w2" head="w1" lemma="--"><dtok form="x"/><dtok form="y"/>xy</tok></s><s><tok id="w1">dup</tok></s></TEI>'
    rows = teitok.parsed(spark.createDataFrame([(1, xml), (2, "<bad")], "doc_id long, xml string"), names={"upos": ("upos", "pos")}).collect()
    assert [(r.form, r.lemma, r.upos, r.head, r.parts, r.entity, r.space_after) for r in rows] == [("A", "a&b", "N", 0, [], "PER", None), ("xy", "_", "_", 1, ["x", "y"], None, None)]
    tokens = tk.with_space_after(annotated(tk.token_table(table(spark, 'a < b & "c"'))))
    assert [r.form for r in teitok.parsed(teitok.documents(tokens)).orderBy("tok_no").collect()] == ["a", "<", "b", "&", '"', "c", '"']


def plain_path(rows, trans, smooth=0.0):
    """rows: of each word tag -> (probability, case factor)."""
    score, back = {k: p for k, (p, _) in rows[0].items()}, []
    for row in rows[1:]:
        top = max(score.values())
        score, now, links = {k: v / top for k, v in score.items()}, {}, {}
        for tag, (p, case) in sorted(row.items()):
            steps = {a: s * ((trans.get((a.split(".")[-1], tag.split(".")[0]), 0.0) + smooth) * (p * case)) for a, s in score.items()}
            best = min(steps, key=lambda a: (-steps[a], a))
            links[tag] = best if steps[best] > 0 else min(score, key=lambda a: (-score[a], a))
            now[tag] = steps[best] if steps[best] > 0 else p
        score = now
        back.append(links)
    tag = min(score, key=lambda a: (-score[a], a))
    path = [tag]
    for links in reversed(back):
        path.append(links[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("smooth", [0.0, 0.5])
def test_paths_of_many_sentences(smooth):
    rnd = random.Random(3)
    tags = ["A", "A.C", "B", "C", "D.B"]
    trans = {(a, b): rnd.randrange(1, 9) for a in "ABC" for b in "ABC" if rnd.random() < 0.7}
    sentences = [[{t: (rnd.random(), rnd.choice([1.0, 0.3])) for t in rnd.sample(tags, rnd.randrange(1, 6))} for _ in range(rnd.randrange(0, 9))] for _ in range(300)]
    flat = [(t, *x) for s in sentences for word in s for t, x in sorted(word.items())]
    paths = tagging.Paths([(a, b, c) for (a, b), c in trans.items()], smooth=smooth)
    lengths, choices = np.array([len(s) for s in sentences]), np.array([len(w) for s in sentences for w in s])
    got = paths.best(lengths, choices, np.array([tags.index(t) for t, _, _ in flat]), tags, np.array([p for _, p, _ in flat]), np.array([c for _, _, c in flat]))
    want = [tags.index(t) for s in sentences if s for t in plain_path(s, trans, smooth)]
    assert got.tolist() == want


def test_paths_are_the_best_of_all():
    rnd = random.Random(4)
    for _ in range(50):
        rows = [{t: (rnd.random(), 1.0) for t in "ABC"} for _ in range(4)]
        trans = {(a, b): rnd.random() for a in "ABC" for b in "ABC"}
        best = max(itertools.product("ABC", repeat=4), key=lambda p: math.prod([rows[0][p[0]][0], *(trans[a, b] * rows[k + 1][b][0] for k, (a, b) in enumerate(itertools.pairwise(p)))]))
        assert tuple(plain_path(rows, trans)) == best


def test_tagging_end_to_end(spark, tmp_path):
    g = annotated(tk.token_table(table(spark, TEXT * 3)))
    m = model.trained(g)
    model.save(m, str(tmp_path / "tables"))
    model.write_json(m, str(tmp_path / "json"), {"corpus_name": 'a "b"'})
    for again in (m, model.load(spark, str(tmp_path / "tables")), model.read_json(spark, str(tmp_path / "json"))):
        got = {r.tok_no: r for r in model.tagged(again, spark.createDataFrame([(1, 0, 0, k, f, u) for k, (f, u) in enumerate([("cat", "_"), ("CAT", "X"), ("zzat", None), ("ϟ", "_"), ("ϟ", "INTJ")])], "doc_id long, line_no int, sent_no int, tok_no int, form string, upos string")).collect()}
        assert [got[k].source for k in range(5)] == ["exact", "existing", "ending", "prior", "existing"]
        assert [got[k].upos for k in (1, 4)] == ["X", "INTJ"] and all(r.upos not in ("_", "") and r.lemma not in ("_", "") for r in got.values())
    assert sorted(map(tuple, model.read_json(spark, str(tmp_path / "json")).vocab.collect())) == sorted(map(tuple, m.vocab.select("form", "lemma", "upos", "xpos", "feats", "cnt").collect()))


def test_lemmas_by_rules(spark):
    rules = spark.createDataFrame([("ing", "V", "*ing#*", 5), ("ing", "V", "*#*", 9), ("ng", "V", "x*#*", 99), ("s", "N", "*s#*", 2), ("s", "N", "*#*", 2)], "ending string, tag string, rule string, cnt long")
    rows = spark.createDataFrame([("sing", "V", None, None), ("walking", "V", None, "ng"), ("cats", "N", "cats", None), ("cats", "N", "cat!", None), ("s", "N", None, None)], "form string, tag string, lemma string, ending string")
    got = sorted((r.form, r.lemma) for r in tagging.refined_lemmas(rows, rules).collect())
    assert got == [("cats", "cat!"), ("cats", "cats"), ("s", "s"), ("sing", "sing"), ("walking", "walking")]


def test_lattice_sums_to_one(spark):
    g = annotated(tk.token_table(table(spark, TEXT * 3)))
    vocab = training.vocabulary(g)
    forms = spark.createDataFrame([("cat",), ("CAT",), ("zzat",), ("ϟ",)], "form string")
    rows = tagging.lattice(forms, vocab, training.endings(vocab), training.tag_types(g))
    assert {r.form: r.source for r in rows.collect()} == {"cat": "exact", "CAT": "lower", "zzat": "ending", "ϟ": "prior"}
    assert all(abs(r.s - 1) < 1e-9 for r in rows.groupBy("form").agg(F.sum("prob").alias("s")).collect())


def plain_alignment(gold, pred, reach=10):
    """gold, pred: (sentence, form, tokid) in order -> (g, p, how), token after token."""
    key = lambda f: "".join(c.lower() for c in f if c.isalnum()) or f.lower()
    bounds = {}
    for k, (s, _, _) in enumerate(pred):
        bounds.setdefault(s, [k, k])[1] = k + 1
    used, out = set(), {}
    for g, (s, form, tokid) in enumerate(gold):
        own = [(-(1000 * (pred[p][0] == s) + (100 if key(pred[p][1]) == key(form) else 50 if key(pred[p][1]) in key(form) or key(form) in key(pred[p][1]) else 0)), p) for p in range(len(pred)) if tokid and pred[p][2] == tokid and p not in used]
        if own:
            out[g] = (min(own)[1], "tokid")
            used.add(min(own)[1])
    for g, (s, form, _) in enumerate(gold):
        if g in out:
            continue
        low, high = bounds.get(s, (g, g))
        same = [p for p in range(len(pred)) if p not in used and key(pred[p][1]) == key(form)]
        near = [(abs(g - p) - 100 * (pred[p][0] == s), p, "sentence") for p in same if low - reach <= p < high + reach] or [(abs(g - p), p, "near") for p in same if abs(g - p) <= 2 * reach]
        if near:
            out[g] = min(near)[1:]
            used.add(out[g][0])
    return sorted((g, p, how) for g, (p, how) in out.items())


def test_alignment_goes_through_the_passes(spark):
    rnd = random.Random(9)
    for kind in range(6):
        gold = [(k // 7, rnd.choice(["a", "b", "B", "c.", "dd", "."]), f"w{k}" if kind % 2 and rnd.random() < 0.3 else None) for k in range(260)]
        pred = [(s, f if rnd.random() < 0.9 else f + "x", i) for s, f, i in gold if rnd.random() < 0.5 + 0.1 * kind]
        if kind == 3:
            pred = [(s + 2, f, i) for s, f, i in pred]
        side = lambda rows: spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "doc_id long, n long, sent_no int, form string, tokid string")
        got = sorted((r.g, r.p, r.how) for r in evaluation.align(side(gold), side(pred)).collect())
        assert got == plain_alignment(gold, pred)
        met = {(r.g, r.p) for r in blocks.align_blocks(side(gold), side(pred)).collect()}
        assert len(met) > len(gold) / 6 and all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(sorted(met)))


def test_depths(spark):
    rows = spark.createDataFrame([(1, 0, 0, k, h) for k, h in enumerate([2, 0, 2, 5, 4, 3])], "doc_id long, line_no int, sent_no int, tok_no int, head int")
    assert {r.tok_no: r.depth for r in evaluation.depths(rows).collect()} == {0: 1, 1: 0, 2: 1, 3: None, 4: None, 5: 2}


def test_covering_spans(spark):
    rnd = random.Random(5)
    sentences = [[rnd.randrange(0, n + 1) for _ in range(n)] for n in range(1, 30)] + [[2, 1, 2], [9, 1], [0, 1, 2, 3, 4, 5, 6, 7]]
    rows = [(1, 0, s, k, h) for s, heads in enumerate(sentences) for k, h in enumerate(heads)]
    got = {(r.sent_no, r.tok_no): (r.first, r.last, r["size"]) for r in evaluation.covering_spans(spark.createDataFrame(rows, "doc_id long, line_no int, sent_no int, tok_no int, head int"), most=64).collect()}
    want = {}
    for s, heads in enumerate(sentences):
        under = {k: set() for k in range(len(heads))}
        lost = set()
        for k in range(len(heads)):
            at, path = k, []
            while at is not None and at not in path:
                path.append(at)
                at = heads[at] - 1 if 0 < heads[at] <= len(heads) else None
            for x in path:
                under[x].add(k)
            lost |= set() if at is None else {k}
        for k, own in under.items():
            want[s, k] = (None,) * 3 if k in lost else (min(own), max(own), len(own))
    assert got == want


def test_entities_in_sentences(spark):
    bounds = spark.createDataFrame([(1, 0, 0, 0, 100), (1, 0, 1, 100, 103)], "doc_id long, line_no int, sent_no int, tok_start long, tok_end long")
    spans = spark.createDataFrame([(1, 98, 100, "X"), (1, 99, 101, "Y"), (1, 100, 103, "Z")], "doc_id long, start long, end long, label string")
    assert sorted((r.sent_no, r.first, r.last, r.label) for r in evaluation.entities_in_sentences(spans, bounds).collect()) == [(0, 99, 100, "X"), (1, 1, 3, "Z")]


def test_upsert_and_splits(spark):
    cols = "language string, backend string, model string, treebank string, mode string, timestamp int, uas double"
    stored = spark.createDataFrame([("en", "b", "m", "t", "auto", 1, 0.5)], cols)
    new = spark.createDataFrame([("en", "b", "m", "t", "auto", 1, 0.6), ("de", "b", "m", "t", "auto", 1, None)], cols)
    assert sorted((r.language, r.uas) for r in reports.upserted(stored, new).collect()) == [("de", None), ("en", 0.6)]
    existing = spark.createDataFrame([(3, "test")], "doc_id long, split string")
    got = {r.doc_id: r.split for r in reports.split_assigned(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id", existing=existing).collect()}
    assert got[3] == "test" and 700 < sum(v == "train" for v in got.values()) < 900


def test_registry():
    assert registry.readers.get("CoNLLU") is conllu.parsed
    assert registry.task_names(["POS", "lemma"]) == ["lemmatize", "segment", "tag", "tokenize"]
