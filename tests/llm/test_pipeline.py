"""The corpus pipeline and decontamination against brute force."""

import os
import random

import corpus_pipeline
import pytest
import regex
from pyspark.sql import functions as F
from test_llm import ODD, WS, edits, plain_score, prose, shingles

from lexmill.llm import common, decontaminate, pieces, toxicity

SLOTS = ("<name>", "<num>", "<unit>")


def plain_canonical(text):
    text = regex.sub(r"(?<=[\p{Ll}\p{N},;:][\x20\x09-\x0D])\p{Lu}[\p{L}\p{M}'’-]*", "<name>", text).lower()
    text = regex.sub(r"(?<![\p{L}\p{N}])[$€£]?[0-9](?:[0-9.,]*[0-9])?(?:st|nd|rd|th|%)?(?![\p{L}\p{N}])", "<num>", text)
    text = regex.sub(rf"(?<=<num>[\x20\x09-\x0D])(?:{decontaminate.UNITS})(?![\p{{L}}\p{{N}}])", "<unit>", text)
    return WS.findall(regex.sub(r"(?<=[\p{L}\p{N}>])[.,;:!?]+(?=[\x20\x09-\x0D]|$)", "", text))


def plain_literal(text):
    return [regex.sub(r"(?<=[^.,;:!?])[.,;:!?]+$", "", w) for w in WS.findall(text.lower())]


def plain_matches(docs, items, width=8, least=12):
    """docs (doc_id, text), items (item_id, text) -> (doc_id, item_id, n_tokens, n_slots, verbatim), every alignment of every pair tried."""
    of = {}
    for item, text in items:
        canon, lits = plain_canonical(text or ""), plain_literal(text or "")
        inner = plain_canonical("x " + (text or "").lstrip())[1:]
        if canon:
            of.setdefault(tuple(canon), []).append((item, lits, inner))
    out = []
    for doc, text in docs:
        canon, lits = plain_canonical(text or ""), plain_literal(text or "")
        best = {}
        for template, members in of.items():
            n = len(template)
            masked = {(k, template[k : k + width]) for k in range(n - width + 1)} | {(0, tuple(inner[:width])) for _, _, inner in members if n >= width}
            masked = {(k, m) for k, m in masked if sum(t not in SLOTS for t in m) * 2 >= width}
            w = min(width, n)
            whole = {(k, tuple(own[k : k + w]), template[k : k + w]) for _, own, _ in members for k in range(n - w + 1)}
            for shift in range(-n, len(canon)):
                met = set()
                for k, m in masked:
                    at = k + shift
                    if at >= 0 and tuple(canon[at : at + width]) == m:
                        met |= {(k + i, False, c, lits[at + i]) for i, c in enumerate(m)}
                for k, m, shown in whole:
                    at = k + shift
                    if at >= 0 and tuple(lits[at : at + w]) == m:
                        met |= {(k + i, True, c, lits[at + i]) for i, c in enumerate(shown)}
                for item, own, inner in members if met else ():
                    places = {}
                    for p, lit, c, o in sorted(x for x in met if not x[1] or own[x[0]] == x[3]):
                        places.setdefault(p, (c, o))
                    slots = [(c, own[p], o) for p, (c, o) in sorted(places.items()) if c in SLOTS]
                    same = len({(c, t) for c, t, _ in slots}) == len(set(slots)) == len({(c, o) for c, _, o in slots})
                    named = list(inner) != list(template) and len(places) == n - 1 >= width and 0 not in places
                    if same and (len(places) >= least or len(places) == n or named):
                        found = (len(places), len(slots), all(t == o for _, t, o in slots))
                        best[item] = max(best.get(item, found), found)
        out += [(doc, item, *f) for item, f in best.items()]
    return out


def questions(rnd, n):
    """Items of a few templates with names, numbers and units, and plain ones of all lengths."""
    forms = ["{a} buys {x} kg of apples and {b} buys {y} kg of pears, then {a} gives {x} apples to {b}.", "How many minutes does a train need for {x} km if it runs {y} km in 3 hours?", "the old baker near the harbour sells {x} loaves"]
    fill = lambda f: f.format(a=rnd.choice(["Tom", "Anna"]), b=rnd.choice(["Eve", "Rita"]), x=rnd.randrange(2, 5), y=rnd.randrange(2, 5))
    return [(k, fill(rnd.choice(forms)) if k % 3 else " ".join(prose(rnd, rnd.randrange(1, 30)))) for k in range(n)], fill, forms


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination_equals_brute_force(spark, broadcast_rows):
    rnd = random.Random(11)
    items, fill, forms = questions(rnd, 40)
    rows = []
    for k in range(150):
        words = prose(rnd, rnd.randrange(0, 40))
        at = rnd.randrange(len(words) + 1)
        middle = [[], [fill(rnd.choice(forms))], [rnd.choice(items)[1].lower()], rnd.choice(items)[1].split()[: rnd.randrange(5, 25)]][k % 4]
        rows.append((1000 + k, rnd.choice([" ", "\n", "  "]).join(words[:at] + middle + words[at:])))
    rows += [rows[1], rows[1], *ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "th", "lits", "wh", "rest")})
    bench = spark.createDataFrame([*items, (None, "one two"), (77, None), (78, "")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_tokens, r.n_slots, r.verbatim) for r in decontaminate.matches(docs, bench, broadcast_rows=broadcast_rows).collect()]
    want = plain_matches(rows, [*items, (None, "one two")])
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 60 and not all(w[4] for w in want)
    if broadcast_rows:
        left = decontaminate.decontaminated(docs, bench)
        assert left.columns == docs.columns
        hit = {w[0] for w in want}
        assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(repr(i) for i, _ in rows if i not in hit)


def plain_lines(rows, least=30):
    """(doc_id, text, ...) rows without the lines that stand earlier, or within one edit of a longer earlier one."""
    order = {r: k for k, r in enumerate(sorted({(i, x) for i, x, *_ in rows}))}
    first, out = {}, []
    flat = sorted((order[i, x], k, y.strip(" \t\v\f\r")) for i, x in order for k, y in enumerate((x or "").split("\n")))
    for d, k, y in flat:
        first.setdefault(y, (d, k))
    near = {y: any(first[z] < p and len(z) >= least and abs(len(z) - len(y)) < 2 and edits(z, y) < 2 for z in first if z != y) for y, p in first.items() if len(y) >= least}
    for i, x, *more in rows:
        kept = [y for k, y in enumerate((x or "").split("\n")) if not y.strip(" \t\v\f\r") or (first[y.strip(" \t\v\f\r")] == (order[i, x], k) and not near.get(y.strip(" \t\v\f\r")))]
        left = x if len(kept) == len((x or "").split("\n")) else "\n".join(kept)
        if left == x or WS.search(left or ""):
            out.append((i, left, *more))
    return out


def plain_groups(rows):
    sets = {i: shingles(x) for i, x, *_ in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    items, fill, forms = questions(rnd, 12)
    base = [prose(rnd, 60) for _ in range(6)]
    rows = []
    for k in range(160):
        words = list(rnd.choice(base)) if k % 4 == 0 else prose(rnd, rnd.randrange(12, 70))
        if k % 4 == 0:
            words[rnd.randrange(len(words))] = f"v{k}"
        if k % 7 == 0:
            words.insert(5, rnd.choice(["scumlech", "lecherous", "scumming"]))
        if k % 11 == 0:
            words.insert(9, fill(forms[k % 2]))
        text = " ".join(words)
        if k % 5 == 0:
            text += "\nAll rights reserved.\n" + f"This page was printed in the year {1990 + k % 3} by us"
        rows.append((k * 3, text))
    rows += [(900, rows[1][1]), (901, ""), (902, None), (903, "one two"), (3, rows[1][1])]
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(*r, "en", f"s{(r[0] or 0) % 5}", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(7) for c in ("score", "key", "rest", "at")})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int((i // 3) % 7 == 0)) for i, _ in rows if i < 480], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, rows, items


def test_stages_equal_brute_force(spark, corpus):
    at, docs, rows, items = corpus
    net = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{at}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    show = lambda df: sorted(map(repr, ((r.doc_id, r.text) for r in df.collect())))
    sizes = [len(rows)]

    want = [r for r in rows if plain_score(net, (r[1] or "").encode()) < 0.5]
    got = common.park(stages["toxicity"](spark, docs, at), "test")
    assert got.columns == docs.columns and show(got) == sorted(map(repr, want))
    sizes.append(len(want))

    want = plain_lines(want)
    got = common.park(stages["line_dedup"](spark, got, at), "test")
    assert got.columns == docs.columns and show(got) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text or "") for r in got.collect())
    sizes.append(len(want))

    label = plain_groups(want)
    want = list({r[0]: r for r in want if label[r[0]] == r[0]}.values())
    got = common.park(stages["near_dedup"](spark, got, at), "test")
    assert got.columns == docs.columns and show(got) == sorted(map(repr, want))
    sizes.append(len(want))

    hit = {m[0] for m in plain_matches(want, items)}
    want = [r for r in want if r[0] not in hit]
    got = common.park(stages["decontamination"](spark, got, at), "test")
    assert got.columns == docs.columns and show(got) == sorted(map(repr, want))
    sizes.append(len(want))
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))

    if os.path.exists(pieces.MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
        tokens = {r.doc_id: (r.n_pieces, r.ids) for r in stages["sentencepiece"](spark, got, at).collect()}
        assert tokens == {i: (len(model.encode(x or "")), model.encode(x or "")) for i, x in want}
        assert {r.doc_id: (r.n_pieces, r.ids) for r in corpus_pipeline.run(spark, at).collect()} == tokens


def test_stages_without_rows_and_without_ids(spark, corpus):
    at, docs, _, _ = corpus
    odd = spark.createDataFrame([(None, "some words of a row"), (None, "some words of a row"), (None, None), (1, "x y"), (1, "x y"), (1, "z")], "doc_id long, text string")
    left = {"toxicity": 6, "line_dedup": 6, "near_dedup": 4, "decontamination": 6, "sentencepiece": 6}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0
        if name != "sentencepiece" or os.path.exists(pieces.MODEL):
            assert stage(spark, odd, at).count() == left[name], name
