"""Alignment of gold and predicted tokens, metrics, error reports."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators.joins import beside
from lexmill.operators.tokens import PLACE, SENTENCE


def same_place(gold: DataFrame, pred: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = PLACE) -> DataFrame:
    """Gold tokens with `pred_*` columns of the predicted token at the same place; null where there is none. `pred` has one token at a place."""
    side = pred.select(*keys, *(F.col(c).alias(f"pred_{c}") for c in columns), F.lit(True).alias("aligned"))
    return beside(gold, side, keys).withColumn("aligned", F.coalesce("aligned", F.lit(False)))


def _indexed(tokens: DataFrame, side: str) -> DataFrame:
    tokid = F.col("tokid") if "tokid" in tokens.columns else F.lit(None).cast("string")
    return tokens.select("doc_id", F.lit(side).alias("side"), F.col("n").cast("long").alias("at"), F.col("sent_no").cast("long").alias("sent"), t.align_key(F.col("form")).alias("key"), F.nullif(tokid, F.lit("")).alias("tokid"))


def _id_type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def _in_groups(rows: DataFrame, key: str, columns: list[str], choose) -> DataFrame:
    """Groups of (document, key) that both sides have, each an array of either side's rows in order: choose(predicted rows, used ones, a gold row) yields (g, p, how).

    Grouping leaves rows that are dealt by document where they are; a batch has many groups, which are far too many for a call each.
    """
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct(*columns)))).alias(name)
    groups = rows.groupBy("doc_id", key).agg(side("g"), side("p")).where("size(g) > 0 and size(p) > 0").select("doc_id", "g", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            values = [_rows(batch.column(c), columns) for c in ("g", "p")]
            for k, (golds, pred) in enumerate(zip(*values, strict=True)):
                used: set = set()
                found = [x for gold in golds for x in choose(pred, used, gold)]
                own += [k] * len(found)
                out += found
            g, p, how = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), pa.array(g, pa.int64()), pa.array(p, pa.int64()), pa.array(how, pa.string())], names=["doc_id", "g", "p", "how"])

    return groups.mapInArrow(run, f"doc_id {_id_type(rows)}, g long, p long, how string")


def _rows(column: pa.Array, columns: list[str]) -> Iterator[list[tuple]]:
    """The tuples of each list of structs."""
    flat = column.flatten()
    every = list(zip(*(flat.field(c).to_pylist() for c in columns), strict=True))
    at = 0
    for n in column.value_lengths().to_pylist():
        yield every[at : at + n]
        at += n


def _by_tokid(pred: list, used: set, gold: list) -> Iterator[tuple]:
    """Of the unused tokens with that id one in the same sentence, then one of a similar form, then the first."""
    at, sent, key = gold
    best = min(((-1000 * (s == sent) - (100 if k == key else 50 if k in key or key in k else 0), p) for p, s, k in pred if p not in used), default=None)
    if best:
        used.add(best[1])
        yield at, best[1], "tokid"


def _by_form(reach: int):
    def choose(pred: list, used: set, gold: list) -> Iterator[tuple]:
        """The nearest within the range of the sentence, else the nearest around."""
        at, sent, low, high = gold

        def best(start: int, stop: int, same: int) -> tuple | None:
            span = range(bisect_left(pred, start, key=itemgetter(0)), bisect_left(pred, stop, key=itemgetter(0)))
            return min(((abs(at - pred[k][0]) - same * (pred[k][1] == sent), pred[k][0]) for k in span if pred[k][0] not in used), default=None)

        how, found = "sentence", best(low, high, 100)
        if found is None:
            how, found = "near", best(at - 2 * reach, at + 2 * reach + 1, 0)
        if found:
            used.add(found[1])
            yield at, found[1], how

    return choose


def align(gold: DataFrame, pred: DataFrame, reach: int = 10) -> DataFrame:
    """gold, pred(doc_id, n running number from 0, sent_no, form, perhaps tokid) -> doc_id, g, p, how: one to one, tokens without a partner left out.

    Gold tokens are taken in order, three times: by equal tokid (same sentence first, then similar forms); by equal
    key within the predicted sentence of the same number, `reach` tokens more on either side (the nearest, 100
    tokens' worth nearer in the same sentence; where that sentence is missing, around the same number); else the
    nearest of equal key at most 2 * reach away. Only tokens of one id or one key compete, so the choice, which
    depends on its order, is made in groups of (document, id) and (document, key).
    """
    both = _indexed(gold, "g").unionByName(_indexed(pred, "p"))
    first, rest = None, both
    if "tokid" in gold.columns and "tokid" in pred.columns:
        first = _in_groups(both.where("tokid is not null"), "tokid", ["at", "sent", "key"], _by_tokid)
        taken = first.select("doc_id", F.lit("g").alias("side"), F.col("g").alias("at")).unionByName(first.select("doc_id", F.lit("p").alias("side"), F.col("p").alias("at")))
        rest = both.join(taken, ["doc_id", "side", "at"], "left_anti")
    # a sentence's range on the predicted side, taken tokens included
    bounds = pred.groupBy("doc_id", F.col("sent_no").cast("long").alias("sent")).agg(F.min("n").alias("low"), (F.max("n") + 1).alias("high"))
    rest = _ranged(rest, bounds).withColumn("low", F.coalesce("low", "at") - reach).withColumn("high", F.coalesce("high", "at") + reach)
    second = _in_groups(rest.where("key <> ''"), "key", ["at", "sent", "low", "high"], _by_form(reach))
    return first.unionByName(second) if first is not None else second


def _ranged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """rows with low and high of their sentence: both laid beside each other by sentence, so that rows dealt by document stay where they are."""
    none = lambda c: F.lit(None).cast("long").alias(c)
    both = rows.select("doc_id", "sent", "side", "at", "key", none("low"), none("high")).unionByName(bounds.where("sent is not null").select("doc_id", "sent", F.lit("b").alias("side"), none("at"), F.lit(None).cast("string").alias("key"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")))
    w = Window.partitionBy("doc_id", "sent")
    return both.withColumn("low", F.max("low").over(w)).withColumn("high", F.max("high").over(w)).where("side <> 'b'")


def metrics(aligned: DataFrame, fields: tuple[str, ...] = ("upos", "xpos", "feats", "lemma")) -> DataFrame:
    """metric, correct, total, accuracy over aligned tokens, feats_partial (predicted within gold) included; accuracy null at 0."""
    checks = {"tokenization": F.col("pred_form") == F.col("form")} | {f: F.col(f"pred_{f}") == F.col(f) for f in fields}
    if "feats" in fields:
        checks["feats_partial"] = t.feats_within(F.col("pred_feats"), F.col("feats"))
        checks["upos_feats"] = (F.col("pred_upos") == F.col("upos")) & (F.col("pred_feats") == F.col("feats"))
    one = aligned.where("aligned").agg(F.count("*").alias("total"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(m) for m, c in checks.items()))
    rows = one.select("total", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("correct")) for m in checks))))
    return rows.select("metric", "correct", "total", F.try_divide("correct", "total").alias("accuracy"))


#: What the parts of a token are scored on.
PART_FIELDS = ("upos", "xpos", "feats", "lemma", "reg", "expan")


def _value(part: Column, field: str) -> Column:
    """A part's value, empty where it is null or _."""
    return F.coalesce(F.nullif(part[field], F.lit("_")), F.lit(""))


def _feats(value: Column) -> Column:
    """Features, key=value without blanks around either; of a repeated key the last counts."""
    pairs = F.transform(F.split(value, r"\|"), lambda x: F.concat(F.trim(F.substring_index(x, "=", 1)), F.lit("="), F.trim(F.regexp_extract(x, "=(.*)$", 1))))
    good = F.filter(F.arrays_zip(F.split(value, r"\|").alias("raw"), pairs.alias("pair")), lambda z: z["raw"].contains("=") & ~z["pair"].startswith("="))
    start = F.array().cast("array<string>")
    return F.aggregate(good, start, lambda kept, z: F.concat(F.filter(kept, lambda y: F.substring_index(y, "=", 1) != F.substring_index(z["pair"], "=", 1)), F.array(z["pair"])))


def feats_match(gold: Column, pred: Column) -> Column:
    """Whether the predicted features are a part of the gold ones: none if gold has none, else one at least."""
    g, p = _feats(gold), _feats(pred)
    within = F.forall(p, lambda x: F.array_contains(g, x))
    return F.when(F.size(g) == 0, F.size(p) == 0).otherwise((F.size(p) > 0) & within)


def part_metrics(aligned: DataFrame) -> DataFrame:
    """metric, correct, total, accuracy over gold tokens and, of multiword ones, their parts.

    aligned: gold columns form and PART_FIELDS, `parts` (array of structs of PART_FIELDS, empty or null without), the same with
    `pred_`, and `aligned`. A field counts where gold has a value, FEATS always, FEATS in part where one side has any, UPOS
    with FEATS where gold has either. All fields of a token without a partner are wrong, and those of one with another number of parts.
    """
    missing = lambda side: [c for c in PART_FIELDS if f"{side}{c}" not in aligned.columns]
    rows = aligned.withColumns({f"{side}{c}": F.lit("_") for side in ("", "pred_") for c in missing(side)})
    kind = f"array<struct<{','.join(f'{c}:string' for c in PART_FIELDS)}>>"
    for side in ("", "pred_"):
        name = f"{side}parts"
        own = F.array(F.struct(*(F.col(f"{side}{c}").cast("string").alias(c) for c in PART_FIELDS)))
        given = F.transform(F.col(name), lambda x: F.struct(*(x[c].cast("string").alias(c) for c in PART_FIELDS))) if name in aligned.columns else F.array().cast(kind)
        rows = rows.withColumn(f"_{name}", F.when(F.size(F.coalesce(given, F.array().cast(kind))) > 0, given).otherwise(own))
    met = F.coalesce(F.col("aligned"), F.lit(False))
    same = met & (F.size("_parts") == F.size("_pred_parts"))
    forms = rows.agg(F.lit("tokenization").alias("metric"), F.count(F.when(met & (F.col("pred_form") == F.col("form")), 1)).alias("correct"), F.count(F.when(met, 1)).alias("total"))
    each = rows.select(met.alias("met"), same.alias("same"), "_pred_parts", F.posexplode("_parts").alias("k", "g")).withColumn("p", F.when(F.col("same"), F.get("_pred_parts", F.col("k"))))
    g, p, ok = (lambda c: _value(F.col("g"), c)), (lambda c: _value(F.col("p"), c)), F.col("same")
    checks = {c: (g(c) != "", ok & (g(c) == p(c))) for c in PART_FIELDS if c != "feats"}
    checks["feats"] = (F.lit(True), ok & (g("feats") == p("feats")))
    checks["feats_partial"] = ((ok & ((g("feats") != "") | (p("feats") != ""))) | (~F.col("met") & (g("feats") != "")), ok & feats_match(g("feats"), p("feats")))
    checks["upos_feats"] = ((g("upos") != "") | (g("feats") != ""), ok & (g("upos") == p("upos")) & (g("feats") == p("feats")))
    one = each.agg(*(x for name, (counts, right) in checks.items() for x in (F.count(F.when(counts, 1)).alias(f"{name}_n"), F.count(F.when(counts & right, 1)).alias(f"{name}_c"))))
    parts = one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"{name}_c").alias("correct"), F.col(f"{name}_n").alias("total")) for name in checks))))
    return forms.unionByName(parts).withColumn("accuracy", F.try_divide("correct", "total"))


def coverage(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.sum(F.col("aligned").cast("long")).alias("aligned"), F.count("*").alias("total"))


def attachment(aligned: DataFrame, keys: tuple[str, ...] = ("doc_id", "line_no", "sent_no")) -> DataFrame:
    """UAS and LAS: the predicted head must be the token aligned with the gold head (0 with 0)."""
    # every token stands at its own place, and once more, asking, at that of its head
    long = lambda c: F.col(c).cast("long").alias(c)
    asks = F.struct(*map(long, ("head", "pred_head")), "deprel", "pred_deprel")
    at = F.array(F.struct((F.col("head") - 1).cast("long").alias("h"), F.when(F.col("aligned"), asks).alias("ask"), F.lit(None).cast("long").alias("is")), F.struct(long("tok_no").alias("h"), F.lit(None).cast(aligned.select(asks.alias("x")).schema["x"].dataType).alias("ask"), long("pred_tok_no").alias("is")))
    rows = aligned.select(*keys, F.inline(at)).withColumn("pred_h", F.first("is", ignorenulls=True).over(Window.partitionBy(*keys, "h")))
    joined = rows.where("ask is not null").select("ask.*", "pred_h")
    right = F.when(F.col("head") == 0, F.col("pred_head") == 0).otherwise(F.coalesce(F.col("pred_head") - 1 == F.col("pred_h"), F.lit(False)))
    one = joined.agg(F.sum(right.cast("long")).alias("UAS"), F.sum((right & (F.col("pred_deprel") == F.col("deprel"))).cast("long")).alias("LAS"), F.count("*").alias("total"))
    return one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("correct"), "total", F.try_divide(m, "total").alias("accuracy")) for m in ("UAS", "LAS")))))


def split_scores(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("doc_id", "line_no", "sent_no", "mwt_start")) -> DataFrame:
    """Recall and precision of multiword tokens, and the share of found ones with the same end."""
    both = gold.select(*keys, F.col("mwt_end").alias("e")).join(pred.select(*keys, F.col("mwt_end").alias("pe")), list(keys), "full_outer")
    return both.agg(F.count("e").alias("gold"), F.count("pe").alias("pred"), F.count(F.when(F.col("e").isNotNull() & F.col("pe").isNotNull(), 1)).alias("found"), F.count(F.when(F.col("e") == F.col("pe"), 1)).alias("same_parts"))


def error_report(tokens: DataFrame, wrong: Column, *by: str) -> DataFrame:
    """Totals and errors by each of the columns and over all, in one pass by grouping sets: grouping, value, total, errors."""
    counted = tokens.withColumn("_wrong", wrong.cast("long"))
    sets = counted.groupingSets([[], *([b] for b in by)], *by).agg(F.count("*").alias("total"), F.sum("_wrong").alias("errors"), F.grouping_id().alias("gid"))
    # grouping_id has a bit for every column that is not grouped by, the first the highest
    full = (1 << len(by)) - 1
    name = F.coalesce(*(F.when(F.col("gid") == full - (1 << (len(by) - 1 - k)), F.lit(b)) for k, b in enumerate(by)), F.lit("all"))
    value = F.coalesce(*(F.when(F.col("gid") == full - (1 << (len(by) - 1 - k)), F.col(b).cast("string")) for k, b in enumerate(by)), F.lit(""))
    return sets.select(name.alias("grouping"), value.alias("value"), "total", "errors")


def oov(forms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Forms that are unknown as they are and in lower case."""
    known = vocab.select("form").distinct()
    rest = forms.join(known, "form", "left_anti")
    return rest.join(known.withColumnRenamed("form", "low"), F.lower(rest.form) == F.col("low"), "left_anti")


def word_frequency(forms: DataFrame, vocab: DataFrame) -> DataFrame:
    """freq: count of the form and, where it differs, of its lower-case form."""
    counts = vocab.groupBy("form").agg(F.sum("cnt").alias("own"))
    low = counts.select(F.col("form").alias("low"), F.col("own").alias("of_low"))
    out = forms.join(counts, "form", "left").join(low, (F.lower(forms.form) == F.col("low")) & (F.lower(forms.form) != forms.form), "left")
    return out.select(*forms.columns, (F.coalesce("own", F.lit(0)) + F.coalesce("of_low", F.lit(0))).alias("freq"))


def entities_in_sentences(spans: DataFrame, bounds: DataFrame, width: int = 64) -> DataFrame:
    """spans(doc_id, start, end exclusive, label) in document token numbers -> those inside a sentence, counted from 1 in it.

    A range join by cells of `width` tokens: a sentence is listed in every cell it touches, a span in that of its start.
    """
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("tok_start") / width), F.floor((F.greatest(F.col("tok_end"), F.col("tok_start") + 1) - 1) / width))))
    joined = spans.withColumn("cell", F.floor(F.col("start") / width)).join(cells, ["doc_id", "cell"]).where("start >= tok_start and end <= tok_end")
    return joined.select("doc_id", "line_no", "sent_no", (F.col("start") - F.col("tok_start") + 1).alias("first"), (F.col("end") - F.col("tok_start")).alias("last"), "label")


def merged_entities(primary: DataFrame, secondary: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The primary entities and those secondary ones that are not among them."""
    return primary.unionByName(secondary.join(primary, list(keys), "left_anti"))


def numbered_entities(entities: DataFrame) -> DataFrame:
    """ne: LABEL_n by order within the label and sentence."""
    w = Window.partitionBy("doc_id", "line_no", "sent_no", "label").orderBy("first", "last")
    return entities.withColumn("ne", F.concat_ws("_", "label", F.row_number().over(w).cast("string")))


def merged_by_confidence(sure: DataFrame, fallback: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...], threshold: float = 0.75) -> DataFrame:
    """`columns` of the fallback where `confidence` of the first is under the threshold."""
    side = fallback.select(*keys, *(F.col(c).alias(f"fb_{c}") for c in columns))
    joined = sure.join(side, list(keys), "left")
    use = (F.col("confidence") < threshold) & F.col(f"fb_{columns[0]}").isNotNull()
    return joined.select(*(F.when(use, F.col(f"fb_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in sure.columns), use.alias("from_fallback"))


def _of_sentences(tokens: DataFrame, most: int, columns: str, work) -> DataFrame:
    """tokens(SENTENCE, tok_no, head) -> SENTENCE, tok_no, columns, of whole sentences, as many at once as a batch has.

    work(up, place, turns) is given for each token the row of its head, -1 at a root and -2 where the head is outside, its tok_no, and how often to double.
    """
    token = F.struct(F.col("tok_no").cast("long").alias("tok_no"), F.col("head").cast("long").alias("head"))
    rows = tokens.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(token)).alias("ts"))
    types = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts = batch.column("ts")
            sizes = ts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ts.flatten()
            place, head = flat.field("tok_no").to_numpy(zero_copy_only=False), flat.field("head").fill_null(0).to_numpy(zero_copy_only=False)
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            # places of all sentences as one rising row of numbers, in which heads are looked up
            low, wide = int(place.min(initial=0)), int(place.max(initial=0)) - int(place.min(initial=0)) + 1
            key, wanted = sentence * wide + place - low, sentence * wide + head - 1 - low
            at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            there = (head > 0) & (head - 1 >= low) & (head - 1 - low < wide) & (key[at] == wanted) if len(key) else np.zeros(0, dtype=bool)
            up = np.where(there, at, np.where(head > 0, -2, -1))
            found = work(up, place, max(1, int(min(most, sizes.max(initial=1))).bit_length()))
            own = [batch.column(c).take(pa.array(sentence)) for c in SENTENCE]
            yield pa.RecordBatch.from_arrays([*own, flat.field("tok_no"), *(pa.array(v, mask=~good) for v, good in found)], names=[*SENTENCE, "tok_no", *names])

    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in SENTENCE) + f", tok_no long, {columns}").withColumn("tok_no", F.col("tok_no").cast(types["tok_no"]))


def depths(tokens: DataFrame, most: int = 10_000) -> DataFrame:
    """Depth of each token under its sentence's root by pointer jumping: each turn doubles the way up, so ~log2(depth) turns over arrays of whole sentences.

    tokens(SENTENCE, tok_no, head 1-based, 0 root). A token in or under a cycle, or with a head outside, has null.
    """

    def work(up: np.ndarray, place: np.ndarray, turns: int) -> list:
        way, lost = (up >= 0).astype(np.int64), up == -2
        for _ in range(turns):
            go = np.flatnonzero(up >= 0)
            if not len(go):
                break
            to = up[go]
            way[go], lost[go], up[go] = way[go] + way[to], lost[to], up[to]
        return [(way, (up < 0) & ~lost)]

    return _of_sentences(tokens, most, "depth long", work)


def covering_spans(tokens: DataFrame, most: int = 10_000) -> DataFrame:
    """tokens(SENTENCE, tok_no, head 1-based, 0 root) -> SENTENCE, tok_no, first, last, size: the first, the last and the number of the tokens under each, itself included.

    A token whose span has more places than tokens (last - first + 1 > size) has others' tokens among its own: an arc into it crosses
    another. By pointer jumping: a turn hands what is known of all tokens less than 2^k below to the one 2^k above, so ~log2(depth)
    turns do over arrays of whole sentences. A head outside the sentence is as none; a token in or under a cycle has nulls.
    """

    def work(up: np.ndarray, place: np.ndarray, turns: int) -> list:
        up = np.maximum(up, -1)
        first, last, size = place.copy(), place.copy(), np.ones(len(up), dtype=np.int64)
        for _ in range(turns):
            go = np.flatnonzero(up >= 0)
            if not len(go):
                break
            # what is known before the turn is handed on, and only that
            to, f, l, s = up[go], first[go], last[go], size[go]  # noqa: E741
            np.minimum.at(first, to, f)
            np.maximum.at(last, to, l)
            np.add.at(size, to, s)
            above = up.copy()
            above[go] = up[to]
            up = above
        return [(x, up < 0) for x in (first, last, size)]

    kind = tokens.schema["tok_no"].dataType.simpleString()
    found = _of_sentences(tokens, most, "first long, last long, size long", work)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("first", "last")})
