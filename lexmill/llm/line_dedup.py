r"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

Lines are the \n-separated parts of a text, trimmed. A line of `least_chars` code points or more is removed
if the same line, or one within one edit (EDITS = 1), stands earlier: in a smaller doc_id, or before it in
its document. Lines are judged on the input. Of shorter lines those of `shortest` code points or more are
removed if the same line stands earlier; `deduplicated` and the query take 1, every line with a word. Without
`shortest` shorter lines stay.

1. Equal lines become one row, with its first place; counting drops repeats on the map side.
2. Each line is split into EDITS + 1 = 2 segments, its first half and the rest; one of them must be unharmed
   by one edit. The index key of a segment holds the line's length, the side and the segment. A line probes
   the keys of its own length and, with substrings cut as in a line shorter by one, those of that length:
   four keys a line. Keys that only one line has are dropped.
3. Lines that share a key are compared by what remains of them outside the segment, with a banded
   bit-parallel automaton: one bit for each diagonal of the band and number of edits, updated by and, or and
   shifts for each code point.
   In a key of more than MOST lines no pairs are made. Two remainders of equal length within one edit agree
   once the same place is cut out of both: each line takes the earliest line for each place cut out. A
   remainder longer by one becomes the shorter one by some cut: it is joined to that by equality. Either way
   a line meets few others, whatever the size of the group, and no link is lost.
4. The places of the lines that stay go back to their documents, as a mask with one byte a line.

A line is known by the place where it first stands. A document's lines are split once wherever they are
needed, so long documents cost no more a line than short ones. A segment that a third of all lines share is
found by counting and its rows are salted.

Defined cases: null text has no lines; repeated rows (same doc_id and text) are one document and stay alike;
rows with one doc_id and different texts are ordered by a hash of the text; a null doc_id sorts last; a
document without words is kept as it is, one that loses all its words is dropped by `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NO_ID, let, packed
from lexmill.operators.joins import salted_join
from lexmill.sources.shared import park

EDITS = 1
LEAST_CHARS = 30
MOST = 128
#: With this as `shortest` equal lines of every length go; a line of no code points has no word and stays.
ANY_LENGTH = 1


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\v\f\r")))


def _cuts(length: Column) -> Column:
    """Code points in the first segment of a line of that length."""
    return F.floor(length / 2).cast("int")


#: The keys of a line: side of the segment, and whether it is an index key (of its own length) or a probe (of one less).
KEYS = ((0, True), (1, True), (0, False), (1, False))


def _key(line: Column, n: Column, side: int, own: bool) -> Column:
    size = n if own else n - 1
    cut = _cuts(size)
    part = F.substring(line, cut + (n - size) + 1, n) if side else F.substring(line, F.lit(1), cut)
    return F.xxhash64(F.lit(side), size, part)


def _remainder(line: Column, side: Column, size: Column) -> Column:
    """What stands outside the segment of that side in a line probed as one of `size` code points."""
    cut = _cuts(size)
    return F.when(side == 0, F.substring(line, cut + 1, F.length(line))).otherwise(F.substring(line, F.lit(1), F.length(line) - (size - cut)))


def code_points(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def within_one(xs: Column, ys: Column) -> Column:
    """Whether two arrays of code points are within one edit. Both must be stored columns: each step reads them.

    The state holds, after j code points of ys, in bits 0-2 the diagonals -1, 0, 1 (code points of xs used,
    less j) reached without an edit, in bits 3-5 those reached with one edit.
    """
    shift = lambda x, k: F.shiftleft(x, k) if k > 0 else F.shiftright(x, -k)
    pairs = F.transform(ys, lambda y, j: sum((F.when((j + d >= 0) & (F.get(xs, j + d) == y), F.lit(1 << (d + 1))).otherwise(F.lit(0)) for d in (-1, 0, 1)), F.lit(0)))

    def step(s: Column, match: Column) -> Column:
        none, one = s.bitwiseAND(F.lit(7)), F.shiftright(s, 3)
        after = none.bitwiseAND(match)
        # with an edit: a match, a code point replaced, one of ys extra, one of xs skipped
        kept = one.bitwiseAND(match).bitwiseOR(none).bitwiseOR(shift(none, -1)).bitwiseOR(shift(after, 1).bitwiseAND(F.lit(7)))
        return after.bitwiseOR(F.shiftleft(kept, 3))

    # at the start diagonal 0 without an edit, diagonal 1 with one
    end = F.aggregate(pairs, F.lit(2 | (4 << 3)), step)
    diagonal = F.size(xs) - F.size(ys)
    bit = F.when(diagonal == -1, F.lit(9)).when(diagonal == 0, F.lit(18)).when(diagonal == 1, F.lit(36)).otherwise(F.lit(0))
    return end.bitwiseAND(bit) != 0


def near_pairs(held: DataFrame) -> DataFrame:
    """held(kh, own, place, rest, chars, members): (gone, by) pairs of places where `gone` is within one edit of the earlier `by`.

    members: how many rows the key kh has. Pairs are made of places alone; the code points join the pairs that are left.
    """
    light = held.select("kh", "own", "place", "rest", "members")
    few, many = light.where(F.col("members") <= MOST).drop("rest", "members"), light.where(F.col("members") > MOST)
    side = lambda df, s: df.select("kh", *(F.col(c).alias(f"{c}_{s}") for c in ("own", "place")))

    small = side(few, "a").join(side(few, "b"), "kh").where("place_a > place_b and (own_a or own_b)")
    cut = lambda place: F.transform(F.sequence(F.lit(1), F.greatest(F.length("rest"), F.lit(1))), lambda i: F.xxhash64(place(i), F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, F.length("rest")))))
    # equal length: the earliest line of each cut; the lines that share one differ in a single character
    same = many.where("own").select("kh", "own", "place", F.explode(cut(lambda i: i)).alias("sig"))
    best = same.groupBy("kh", "sig").agg(F.min(F.struct("place", "own")).alias("m"))
    best = best.select("kh", "sig", *(F.col(f"m.{c}").alias(f"{c}_b") for c in ("own", "place")))
    same = same.select("kh", "sig", *(F.col(c).alias(f"{c}_a") for c in ("own", "place"))).join(best, ["kh", "sig"]).where("place_a > place_b").drop("sig")
    # longer by one: the line that some cut makes equal
    longer = many.where("not own").select("kh", "own", "place", F.explode(F.array_distinct(cut(lambda i: F.lit(0)))).alias("sig"))
    shorter = many.where("own").select("kh", "own", "place", F.xxhash64(F.lit(0), "rest").alias("sig"))
    pick = lambda df, s: df.select("kh", "sig", *(F.col(c).alias(f"{c}_{s}") for c in ("own", "place")))
    both = pick(longer, "a").join(pick(shorter, "b"), ["kh", "sig"]).drop("sig")
    later = F.col("place_a") > F.col("place_b")
    turned = both.select("kh", *(F.when(later, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("own", "place")))
    met = small.unionByName(same).unionByName(turned).where("place_a <> place_b").select("kh", "place_a", "own_a", "place_b", "own_b").distinct()
    chars = lambda s: held.select("kh", F.col("place").alias(f"place_{s}"), F.col("own").alias(f"own_{s}"), F.col("chars").alias(f"chars_{s}"))
    met = met.join(chars("a"), ["kh", "place_a", "own_a"]).join(chars("b"), ["kh", "place_b", "own_b"])
    near = met.where(F.abs(F.size("chars_a") - F.size("chars_b")) < 2).where(within_one(F.col("chars_a"), F.col("chars_b")))
    return near.select(F.col("place_a").alias("gone"), F.col("place_b").alias("by")).distinct()


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))


def _mask(positions: Column) -> Column:
    """Binary with a 1 at each of the places (numbers from 0) and a 0 between."""
    piece = lambda ps: F.transform(ps, lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.get(ps, i - 1)).otherwise(-1) - 1), F.lit("1")))
    return F.array_join(let(F.array_sort(positions), piece), "").cast("binary")


def staying(docs: DataFrame, least_chars: int = LEAST_CHARS, shortest: int | None = None) -> DataFrame:
    """key, th, stay binary: a mask of the document's lines of `shortest` (or else `least_chars`) or more that stay."""
    rows = _rows(docs)
    line = F.col("line")
    each = rows.select("key", "th", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("n", F.length("line")).where(F.col("n") >= min(least_chars, least_chars if shortest is None else shortest))
    n = F.col("n")
    each = each.select(F.xxhash64(line).alias("id"), F.xxhash64(F.lit(1), line).alias("id2"), F.struct("key", "th", "pos").alias("place"), "n", *(F.when(n >= least_chars, _key(line, n, *k)).alias(f"k{i}") for i, k in enumerate(KEYS)))
    lines = each.groupBy("id", "id2").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")))
    lines = park(lines.drop("id", "id2"), "line-rows")

    entry = lambda i, side, own: F.struct(F.col(f"k{i}").alias("kh"), F.lit(side).alias("side"), (n if own else n - 1).alias("n"), F.lit(own).alias("own"))
    keys = lines.where(n >= least_chars).select("place", F.inline(F.array(*(entry(i, *k) for i, k in enumerate(KEYS)))))
    shared = park(keys.groupBy("kh").agg(F.count("*").alias("members"), F.max("own").alias("any_own")).where("members > 1 and any_own").select("kh", "members"), "line-shared")
    held = park(salted_join(keys, shared, "kh", "place", counted="members"), "line-keys")
    # the candidates' texts, from the documents where they first stand
    wanted = held.groupBy("place").agg(F.collect_list(F.struct("kh", "members", "side", "n", "own")).alias("ks")).select("place.key", "place.th", "place.pos", "ks")
    texts = rows.dropDuplicates(["key", "th"]).join(wanted.groupBy("key", "th").agg(F.collect_list(F.struct("pos", "ks")).alias("ps")), ["key", "th"])
    found = let(lines_of(F.col("text")), lambda ls: F.transform("ps", lambda p: F.struct(p["pos"].alias("pos"), F.get(ls, p["pos"]).alias("line"), p["ks"].alias("ks"))))
    texts = texts.select("key", "th", F.inline(found)).select(F.struct("key", "th", "pos").alias("place"), "line", F.inline("ks"))
    texts = texts.select("kh", "members", "own", "place", _remainder(F.col("line"), F.col("side"), F.col("n")).alias("rest"))
    texts = park(texts.withColumn("chars", code_points(F.col("rest"))), "line-candidates")
    gone = near_pairs(texts).select(F.col("gone").alias("place")).distinct()
    left = lines.select("place").join(gone, "place", "left_anti")
    return left.groupBy(F.col("place.key").alias("key"), F.col("place.th").alias("th")).agg(F.collect_list("place.pos").alias("stay")).select("key", "th", _mask(F.col("stay")).alias("stay"))


def _marked(docs: DataFrame, least_chars: int, shortest: int | None) -> DataFrame:
    """rest (struct of the columns beside text), text, gone (number of lines that go), left (the text without them)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = packed(docs).select("rest", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("th"))
    joined = rows.join(staying(docs, least_chars, shortest), ["key", "th"], "left")
    least = min(least_chars, least_chars if shortest is None else shortest)
    held = F.coalesce("stay", F.lit(b""))
    stays = lambda x, i: (F.length(F.trim(x, F.lit(" \t\v\f\r"))) < least) | (F.substring(held, i + 1, F.lit(1)) == F.lit(b"1"))
    joined = joined.withColumn("kept", F.filter(F.split(text, "\n"), stays))
    gone = F.size(F.split(text, "\n")) - F.size("kept")
    return joined.select("rest", "text", gone.alias("gone"), F.when(gone == 0, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("left"))


def with_lines_left(docs: DataFrame, least_chars: int = LEAST_CHARS, shortest: int | None = None) -> DataFrame:
    """docs with all columns and `_left`: the text without the lines that go, `_gone`: their number (columns of these names are replaced)."""
    found = _marked(docs, least_chars, shortest)
    columns = [c for c in docs.columns if c.lower() not in ("_left", "_gone")]
    return found.select(*(F.col("text").alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in columns), F.col("left").alias("_left"), F.col("gone").alias("_gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, same columns, without the lines that go; documents that lose all their words go too. A column n_chars is set anew where lines went."""
    found = _marked(docs, LEAST_CHARS, ANY_LENGTH).where((F.col("gone") == 0) | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    own = lambda c: F.col("rest").getField(c)
    size = lambda c: F.when(F.col("gone") == 0, own(c)).otherwise(F.length("left").cast(docs.schema[c].dataType))
    return found.select(*(F.col("left").alias(c) if c == "text" else (size if c == "n_chars" else own)(c).alias(c) for c in docs.columns))
