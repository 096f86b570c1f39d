"""Mixing, fill-in-middle and hard negatives against plain versions on small tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import infill, mixing, negatives

WS = re.compile("[^\x20\x09-\x0d]+")
CLASH = ("size", "target", "key", "n", "form", "output", "row", "score", "label", "filled", "host", "taken")


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df


def corpus(seed=5, n=300):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rnd.choice([1, 3, 40, 700]))), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(n)]
    rows += [(None, "a b c", None), (None, "a b c", None), (None, None, "s1"), (-4, "", "S"), (-5, " \n", "é"), (-6, "x y", "😀"), (-6, "x y", "😀"), (-6, "x y z", "😀"), (-7, "long " * 30_000, "s2")]
    return rows + [(10**6, "copy of it", "big")] * 40


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, weight, out = share * sum(sizes.values()), {s: weights[k % len(weights)] for k, s in enumerate(names)}, {}
    while names:
        unit = left / sum(weight[s] for s in names)
        full = [s for s in names if unit * weight[s] >= passes * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in names}
        for s in full:
            out[s] = passes * sizes[s]
            left -= out[s]
        names = [s for s in names if s not in full]
    return out


def plain_mix(rows, packet=256):
    docs, seen, sizes = [], collections.Counter(), collections.Counter()
    for i, text, source in rows:
        size = len(WS.findall(text or ""))
        seen[i, size, source] += 1
        name = f"7:{'' if i is None else i}:{size}:{seen[i, size, source]}"
        docs.append((source, int(hashlib.md5(name.encode()).hexdigest()[:15], 16), i, size, seen[i, size, source]))
        sizes[source] += size
    target, done, queue = plain_targets(sizes), collections.Counter(), []
    order = lambda d: (d[1], d[2] is not None, d[2] or 0, d[3], d[4])
    for turn in range(2):
        for d in sorted(docs, key=order):
            for part in range(-(-d[3] // packet)):
                words = min(packet, d[3] - part * packet)
                done[d[0]] += words
                queue.append((done[d[0]] / target[d[0]], d[0] is None, d[0] or "", turn, part, words, d))
    total, taken = 0, collections.Counter()
    for *_, words, d in sorted(queue, key=lambda q: q[:5]):
        total += words
        if total <= 1.5 * sum(sizes.values()):
            taken[d] += words
    return [(d[2], d[3], sizes[d[0]], round(float(target[d[0]]), 6), taken[d]) for d in docs], target


@pytest.mark.parametrize("bucket", [4_096, 8])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10_000 if bucket > 8 else 2)
    rows = corpus()
    got = mixing.mixed(table(spark, rows)).collect()
    want, target = plain_mix(rows)
    assert sorted(map(repr, ((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got))) == sorted(map(repr, want))
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 256 for s, t in target.items()) and None in target
    # the same rows in another order and other partitions
    again = mixing.mixed(table(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_places_in_the_mix(spark):
    queue = mixing.queued(table(spark, corpus()))
    mix = sorted(mixing.packets(queue).collect(), key=lambda r: r.total)
    at = 0
    for r, after in zip(mix, mix[1:] + [None]):
        at += r.words
        assert r.total == at and (after is None or r.finish <= after.finish)
    # every source keeps pace: at each moment its words are its share of the time, less a packet
    done = collections.Counter()
    for r in mix:
        done[r.host] += r.words
        assert all(done[h] <= 256 + r.finish * t for h, t in {(x.host, x.target) for x in mix[:1] + [r]})


def test_mix_of_nothing(spark):
    empty = table(spark, corpus()).limit(0)
    assert mixing.mixed(empty).count() == 0
    got = mixing.mixed(table(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError):
        mixing.mixed(table(spark, corpus()))


def plain_infill(i, text, rate=100):
    text = text or ""
    lines = text.split("\n")
    units = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    hexes = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate", [100, 30])
def test_fill_in_middle(spark, rate):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a", "\n", "\n", "é😀", "<", "P>", "S", ">", "\r", "\x85", "<M"]) for _ in range(rnd.randrange(40))) for _ in range(400)]
    texts += [None, "", "\n", "\n\n", "x", "holds <S> itself", "long line " * 50_000, "y\n" * 100_000]
    rows = [(None if k % 50 == 7 else k * 10**14, t, "s") for k, t in enumerate(texts)] + [(4, "one\ntwo\nthree", "s")] * 2
    got = infill.fill_in_middle(table(spark, rows), infill.Rule(rate=rate)).collect()
    assert len(got) == len(rows) and {"_n", "_form", "_output", "n"} <= set(got[0].asDict())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *made, sha(made[-1]), sha(t or "")) for i, t, _ in rows for made in [plain_infill(i, t, rate)]]
    assert sorted(map(repr, ((r.doc_id, r["_n"], r["_form"], r.prefix_chars, r.middle_chars, r["_output"], r.output_sha256, r.restored_sha256) for r in got))) == sorted(map(repr, want))
    assert {r["_form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(table(spark, rows).limit(0)).count() == 0


def test_infill_of_other_units():
    rule = infill.Rule(unit=r"\S+\s*|\s+", prefix="⟨pre⟩", suffix="⟨suf⟩", middle="⟨mid⟩")
    import regex

    for k in range(50):
        n, form, first, middle, output = infill.cut("a few words  of text", str(k), rule, regex.compile(rule.unit))
        assert n == 5 and infill.restored(output, form, rule) == "a few words  of text"
    for bad in (dict(prefix="<<"), dict(prefix="<S>"), dict(middle=""), dict(suffix="[S]")):
        with pytest.raises(ValueError):
            infill.Rule(**bad)


def plain_negatives(rows, every=4, n_pos=5, n_neg=10):
    sound = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = collections.Counter(len(v) for _, v, _ in sound)
    dim = min(dims, key=lambda d: (-dims[d], d), default=0)
    sound = [r for r in sound if len(r[1]) == dim]
    out = []
    for k, (a, v, y) in enumerate(sound):
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z, j) for j, (i, w, z) in enumerate(sound) if j != k)
        for score, p, *_ in [s for s in scored if s[2] == y][:n_pos]:
            fit = [(i, -s) for s, i, z, _ in scored if z != y and 30 * -score <= 100 * -s <= 90 * -score][:n_neg]
            out += [(a, p, r + 1, i, -score, s) for r, (i, s) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("wave", [1_024, 3])
def test_hard_negatives(spark, monkeypatch, wave):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 7))
    rows = [(i, [float(x) for x in (centres[i % 4] * (i % 3) + r.normal(size=7)) / 4], int(r.integers(0, 3))) for i in range(220)]
    rows += [(i, rows[5][1], 1) for i in range(300, 330)] + [(i, rows[6][1], 2) for i in range(300, 316)]  # copies, two rows of one id
    rows += [(400, None, 1), (404, [1.0] * 7, None), (408, [None] + [1.0] * 6, 1), (412, [float("nan")] * 7, 1), (416, [float("inf")] + [0.0] * 6, 1), (420, [1.0], 1), (None, [0.2] * 7, 1), (424, [0.0] * 7, 0), (428, [-0.3] * 7, 2), (-8, [0.3] * 7, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("row", "v", "codes", "score", "slot")})
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = sorted(tuple(x) for x in negatives.hard_negatives(df.repartition(5), every=4, wave=wave).collect())
    want = plain_negatives(rows)
    assert got == want and len(want) > 500


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in negatives.hard_negatives(df).collect()) == [(0, 1, 1, 2, 0, 0)]
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(4)
    v = r.integers(-300, 300, size=(500, 9))
    q = negatives.fitted(v[:64], 2)
    codes, rest = q.codes(v)
    anchors = v[:20]
    about = sum(t[codes[:, m]] for m, t in enumerate(q.tables(anchors)))
    exact = v @ anchors.T
    assert (np.abs(about - exact) <= np.outer(rest, np.sqrt((anchors.astype(float) ** 2).sum(1))) + 1).all() and np.abs(about - exact).max() > 0
