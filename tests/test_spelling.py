"""Affix rules, lookup and nearest forms against plain versions."""

import random

from pyspark.sql import functions as F

from lexmill.operators import spelling

AFF = """SET UTF-8
NEEDAFFIX X
FORBIDDENWORD !
PFX U Y 2
PFX U 0 un [^u]
PFX U u on u
SFX S Y 3
SFX S y ies [^aeiou]y
SFX S 0 s [^sxy]
SFX S 0 es [sx]
SFX D Y 2
SFX D 0 d/S e
SFX D y ied [^aeiou]y
SFX N N 1
SFX N 0 -like/S [x-z]
SFX Q Y 1
SFX Q q 0 q
"""
DIC = """9
try/SDU
bake/DSU
user/US
fox/S
key/SN
only/X
stub/XS
q/Q
badly/!
tries/!
and\\/or/S
fox/N
plain
"""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_affixes(spark, tmp_path):
    (tmp_path / "x.aff").write_text(AFF)
    (tmp_path / "x.dic").write_text(DIC)
    rules = spelling.read_affixes(spark, str(tmp_path / "x.aff"))
    words = spelling.read_words(spark, str(tmp_path / "x.dic"))
    assert rules.count() == 9 and words.count() == 13
    said = spelling.directives(spark, str(tmp_path / "x.aff"))
    got = {tuple(r) for r in spelling.expanded(words, rules, said["NEEDAFFIX"], said["FORBIDDENWORD"]).collect()}
    forms = {r[0] for r in got}
    # a hyphen between brackets is a hyphen: y is not in [x-z]
    want = "try tried untry untries untried bake bakes baked bakeds unbake unbakes unbaked unbakeds user users onser onsers fox foxes fox-like fox-likes key stubs q plain and/or and/ors"
    assert forms == set(want.split()), forms ^ set(want.split())
    assert ("unbakeds", "bake", "U", "DS") in got and ("plain", "plain", "", "") in got
    shuffled = spelling.FEW
    try:
        spelling.FEW = 2  # by shuffle instead of a broadcast
        assert {tuple(r) for r in spelling.expanded(words, rules, "X", "!").collect()} == got
    finally:
        spelling.FEW = shuffled
    assert spelling.expanded(words.limit(0), rules).isEmpty() and spelling.expanded(words, rules.limit(0)).count() == 12


def test_flag_kinds(spark, tmp_path):
    for kind, flags in (("long", "AaBb"), ("num", "12,7")):
        (tmp_path / f"{kind}.aff").write_text(f"FLAG {kind}\nSFX {'Bb' if kind == 'long' else '7'} Y 1\nSFX {'Bb' if kind == 'long' else '7'} 0 s .\n")
        (tmp_path / f"{kind}.dic").write_text(f"1\ncat/{flags}\n")
        rules = spelling.read_affixes(spark, str(tmp_path / f"{kind}.aff"))
        assert {r.form for r in spelling.expanded(spelling.read_words(spark, str(tmp_path / f"{kind}.dic"), kind), rules).collect()} == {"cat", "cats"}


def test_nearest_forms_equal_brute_force_on_ten_thousand_words(spark):
    rnd = random.Random(4)
    parts = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    forms = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 7))) for _ in range(14_000)})[:10_000]
    assert len(forms) == 10_000 and max(map(len, forms)) > spelling.PREFIX + 4

    def spoiled(w):
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w = w[:k] + rnd.choice(["", "a", "z"]) + w[k + rnd.randrange(2) :]
        return w

    asked = sorted({spoiled(rnd.choice(forms)) for _ in range(60)} | {"a", "zz", "", "x" * 3000})
    got = spelling.suggestions(spark.createDataFrame([(w,) for w in asked + ["a", None]], "word string"), spark.createDataFrame([(w,) for w in forms + [forms[0], None, ""]], "form string"))
    got = sorted(map(tuple, got.collect()))
    want = sorted((w, f, d) for w in asked if w for f in forms if abs(len(w) - len(f)) <= 2 and (d := distance(w, f)) <= 2)
    assert got == want and len(want) > 200


def test_prefixes_lose_nothing(spark):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for prefix in (3, 5):
        got = sorted(map(tuple, spelling.suggestions(df, df.withColumnRenamed("word", "form"), 2, prefix).collect()))
        assert got == sorted((a, b, d) for a in words for b in words if (d := distance(a, b)) <= 2)


def test_corrections(spark):
    forms = spark.createDataFrame([("house",), ("mouse",), ("Paris",), ("two",), ("NATO",)], "form string")
    asked = ["house", "House", "HOUSE", "houze", "Houze", "HOUZE", "fouse", "paris", "PARIS", "Pariss", "qqqqqq", "Tow", "nato", None, ""]
    got = {r.word: (r.known, r.reg) for r in spelling.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), forms).collect()}
    assert set(got) == {w for w in asked if w}
    assert all(got[w] == (True, None) for w in ("house", "House", "HOUSE", "PARIS")) and got["qqqqqq"] == (False, None)
    assert [got[w][1] for w in ("houze", "Houze", "HOUZE", "fouse", "paris", "Pariss", "Tow")] == ["house", "House", "HOUSE", "house", "Paris", "Paris", "Two"]
    tokens = spark.createDataFrame([(k, w) for k, w in enumerate(["houze"] * 6000 + ["house", "h0uze", None, "."])], "k int, form string")
    out = spelling.normalized(tokens, forms)
    assert out.count() == 6004 and {(r.form, r.reg) for r in out.distinct().collect() if r.reg} == {("houze", "house")}
    assert spelling.normalized(tokens.limit(0), forms).isEmpty() and spelling.normalized(tokens, forms.limit(0)).where("reg is not null").isEmpty()
