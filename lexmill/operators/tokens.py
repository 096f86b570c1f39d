"""Token tables and what is read off their order.

A token row is keyed (doc_id, line_no, sent_no, tok_no). Splitting is one chain of generators without a
shuffle; everything ordered works within a sentence (SENTENCE), so windows shuffle by sentence and never
gather a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators.joins import beside

SENTENCE = ("doc_id", "line_no", "sent_no")
PLACE = (*SENTENCE, "tok_no")
#: ASCII punctuation, as one character class; fixed values.
PUNCTUATION = r"""^[!-/:-@\[-`{-~]$"""


def in_sentence() -> Window:
    return Window.partitionBy(*SENTENCE).orderBy("tok_no")


def line_table(docs: DataFrame, *extra: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, extra, line_no, line; blank lines left out."""
    return docs.select("doc_id", *extra, F.posexplode(t.lines(F.col("text"))).alias("line_no", "line")).where("line <> ''")


def sentence_table(docs: DataFrame, *extra: str) -> DataFrame:
    return line_table(docs, *extra).select("doc_id", *extra, "line_no", F.posexplode(t.sentences(F.col("line"))).alias("sent_no", "sent"))


def token_table(docs: DataFrame, *extra: str, **options: bool) -> DataFrame:
    return sentence_table(docs, *extra).select("doc_id", *extra, "line_no", "sent_no", F.posexplode(t.tokens(F.col("sent"), **options)).alias("tok_no", "form"))


def with_space_after(tokens: DataFrame) -> DataFrame:
    """space_after: whether the next token starts with a letter or number; null at a sentence's end."""
    following = F.lead("form").over(in_sentence())
    return tokens.withColumn("space_after", following.rlike(r"^[\p{L}\p{N}]"))


def is_punctuation(upos: Column, form: Column) -> Column:
    return F.coalesce(upos == "PUNCT", F.lit(False)) | form.rlike(PUNCTUATION)


def rebuilt(tokens: DataFrame) -> DataFrame:
    """Sentence texts from forms and space_after (null and true give a blank)."""
    piece = F.concat("form", F.when(F.col("space_after") == F.lit(False), "").otherwise(" "))
    ordered = F.array_sort(F.collect_list(F.struct("tok_no", piece.alias("piece"))))
    return tokens.groupBy(*SENTENCE).agg(F.rtrim(F.array_join(ordered["piece"], "")).alias("text"))


def with_offsets(tokens: DataFrame) -> DataFrame:
    """char_start, char_end of each token in its rebuilt sentence."""
    size = F.length("form") + F.when(F.col("space_after") == F.lit(False), 0).otherwise(1)
    before = F.coalesce(F.sum(size).over(in_sentence().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tokens.withColumn("char_start", before).withColumn("char_end", before + F.length("form"))


def located(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """char_start of each token in its source sentence: a fold that looks for each form behind the last one.

    tokens(SENTENCE, tok_no, form), sentences(SENTENCE, sent) -> SENTENCE, tok_no, form, char_start; -1 where a form isn't found.
    """
    forms = tokens.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct("tok_no", "form"))).alias("ts"))
    # the next search starts behind the form found before; a form that isn't found keeps the place
    folded = F.expr("""
        aggregate(ts, struct(1 as at, cast(array() as array<int>) as starts),
            (s, x) -> if(locate(x.form, sent, s.at) > 0,
                struct(locate(x.form, sent, s.at) + length(x.form) as at, array_append(s.starts, locate(x.form, sent, s.at) - 1) as starts),
                struct(s.at as at, array_append(s.starts, -1) as starts)),
            s -> s.starts)""")
    joined = forms.join(sentences, list(SENTENCE)).withColumn("starts", folded)
    return joined.select(*SENTENCE, F.inline(F.arrays_zip(F.col("ts.tok_no").alias("tok_no"), F.col("ts.form").alias("form"), F.col("starts").alias("char_start"))))


def sentence_bounds(tokens: DataFrame) -> DataFrame:
    """first and last (exclusive) running token number of each sentence in its document."""
    sizes = tokens.groupBy(*SENTENCE).agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("line_no", "sent_no")
    return sizes.withColumn("tok_end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tok_start", F.col("tok_end") - F.col("n"))


def context(tokens: DataFrame, reach: int = 2) -> DataFrame:
    """The forms around a token, itself between angle brackets."""
    w = in_sentence()
    left, right = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
    return tokens.withColumn("context", F.concat_ws(" ", F.collect_list("form").over(left), F.concat(F.lit("<"), "form", F.lit(">")), F.collect_list("form").over(right)))


def implicit_mwts(tokens: DataFrame) -> DataFrame:
    """Runs of tokens without blanks between them as multiword tokens.

    A run of two tokens or more counts if it holds no punctuation, if it is a pair whose second token is
    punctuation with an apostrophe, or if all punctuation in it is hyphens between words. A run that doesn't
    count is tried again from its second token on, and so on. -> SENTENCE, mwt_start, mwt_end, form.
    """
    w = in_sentence()
    joined = tokens.withColumn("new", F.coalesce(F.lag("space_after").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    member = F.struct("tok_no", "form", is_punctuation(F.col("upos"), F.col("form")).alias("punct"))
    runs = joined.groupBy(*SENTENCE, "run").agg(F.array_sort(F.collect_list(member)).alias("ms")).where(F.size("ms") > 1)
    # where a tail of the run first counts: behind its last disqualifying start
    tails = F.transform(F.sequence(F.lit(1), F.size("ms") - 1), lambda i: F.slice("ms", i, F.size("ms")))

    def counts(ms: Column) -> Column:
        marks = F.filter(ms, lambda m: m["punct"])
        contraction = (F.size(ms) == 2) & F.element_at(ms, 2)["punct"] & F.element_at(ms, 2)["form"].contains("'")
        compound = F.forall(marks, lambda m: m["form"].isin("-", "–", "—")) & ~F.element_at(ms, 1)["punct"] & ~F.element_at(ms, -1)["punct"]
        return (F.size(marks) == 0) | contraction | compound

    good = F.element_at(F.filter(tails, counts), 1)
    found = runs.withColumn("good", F.when(F.exists(tails, counts), good)).where("good is not null")
    return found.select(*SENTENCE, F.element_at("good", 1)["tok_no"].alias("mwt_start"), F.element_at("good", -1)["tok_no"].alias("mwt_end"), F.array_join(F.col("good.form"), "").alias("form"))


def contraction_pairs(tokens: DataFrame) -> DataFrame:
    """Neighbours without a blank, neither of them punctuation, merged pairwise from the left. -> SENTENCE, first, second, form."""
    w = in_sentence()
    punct = is_punctuation(F.col("upos"), F.col("form"))
    rows = tokens.withColumn("punct", punct).withColumn("next_form", F.lead("form").over(w)).withColumn("next_no", F.lead("tok_no").over(w)).withColumn("next_punct", F.lead("punct").over(w))
    rows = rows.withColumn("joins", F.coalesce((F.col("space_after") == F.lit(False)) & ~F.col("punct") & ~F.col("next_punct"), F.lit(False)))
    # in a chain of joining tokens the odd ones start a pair
    rows = rows.withColumn("chain", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w)).withColumn("chain", F.when(F.col("joins"), F.col("chain")).otherwise(-1))
    rank = F.row_number().over(Window.partitionBy(*SENTENCE, "chain").orderBy("tok_no"))
    return rows.where("joins").withColumn("rank", rank).where("rank % 2 = 1").select(*SENTENCE, F.col("tok_no").alias("first"), F.col("next_no").alias("second"), F.concat("form", "next_form").alias("form"))


def atomic(tokens: DataFrame) -> DataFrame:
    """The parts (array<struct<form, upos>>) of a multiword token, else the token itself."""
    own = F.array(F.struct("form", "upos"))
    return tokens.select(*PLACE, F.posexplode(F.when(F.size(F.coalesce("parts", F.array().cast("array<struct<form:string,upos:string>>"))) > 0, F.col("parts")).otherwise(own)).alias("part_no", "part")).select(*PLACE, "part_no", "part.form", "part.upos")


def detagged(tokens: DataFrame, columns: tuple[str, ...] = ("lemma", "upos", "xpos", "feats", "head", "deprel")) -> DataFrame:
    """Annotation columns emptied, the form kept."""
    return tokens.select(*(F.lit("_").alias(c) if c in columns else F.col(c) for c in tokens.columns))


def merged_detagged(tokens: DataFrame, mwts: DataFrame) -> DataFrame:
    """tokens(SENTENCE, tok_no, form, ...) without annotation, the parts of each of mwts(SENTENCE, mwt_start, mwt_end, form) as one token.

    It stands at the place of its first part and has that one's columns, but the multiword token's form (without one, or with _, the
    forms of its parts joined) and the space_after of its last part. Multiword tokens don't overlap; those without tokens give none.
    """
    form = F.nullif(F.nullif("form", F.lit("")), F.lit("_")).alias("mwt_form")
    parts = mwts.select(*SENTENCE, "mwt_start", form, F.explode(F.sequence("mwt_start", "mwt_end")).alias("tok_no"))
    rows = beside(detagged(tokens), parts, PLACE)
    own = [c for c in tokens.columns if c not in (*SENTENCE, "tok_no", "form", "space_after")]
    first = lambda c: F.min_by(c, "tok_no").alias(c)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", F.coalesce("form", F.lit("")).alias("form")))), lambda x: x.form), "")
    last = [F.max_by("space_after", "tok_no").alias("space_after")] if "space_after" in tokens.columns else []
    grouped = rows.groupBy(*SENTENCE, F.coalesce("mwt_start", "tok_no").alias("place"))
    out = grouped.agg(F.min("tok_no").alias("tok_no"), F.coalesce(F.max("mwt_form"), joined).alias("form"), *last, *map(first, own))
    return out.select(*tokens.columns)


#: Columns that a task fills.
TASK_COLUMNS = {"tag": ("upos", "xpos", "feats"), "lemmatize": ("lemma",), "parse": ("head", "deprel"), "normalize": ("reg",), "ner": ("entity",)}


def keep_tasks(tokens: DataFrame, tasks: tuple[str, ...]) -> DataFrame:
    """Empties the columns of all tasks but the named ones."""
    gone = {c for task, cols in TASK_COLUMNS.items() if task not in tasks for c in cols}
    return detagged(tokens, tuple(gone))


def task_flags(tokens: DataFrame, *by: str) -> DataFrame:
    """Which tasks have been done, by group: whether any token has their columns filled."""
    full = lambda c: ~F.coalesce(F.col(c).cast("string"), F.lit("_")).isin("_", "")
    filled = lambda cols: F.bool_or(F.exists(F.array(*map(full, cols)), lambda x: x))
    return tokens.groupBy(*by).agg(*(filled([c for c in cols if c in tokens.columns]).alias(task) for task, cols in TASK_COLUMNS.items() if any(c in tokens.columns for c in cols)))


def with_annotations(tokens: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Tokens of the sentences that have each required annotation at least once."""
    good = tokens.groupBy(*SENTENCE).agg(*(F.bool_or(~F.coalesce(F.col(c).cast("string"), F.lit("_")).isin("_", "")).alias(c) for c in required)).where(F.forall(F.array(*required), lambda x: x)).select(*SENTENCE)
    return tokens.join(good, list(SENTENCE), "left_semi")


def with_nlp_form(tokens: DataFrame) -> DataFrame:
    """form := the regularised form, where there is one."""
    return tokens.withColumn("form", F.coalesce(F.when(~F.col("reg").isin("_", ""), F.col("reg")), F.col("form")))


def with_ids_of(target: DataFrame, source: DataFrame) -> DataFrame:
    """target(doc_id, sent_id, sent_no, tok_no, tokid) with ids of source tokens at the same place of the same sentence; ids there stay.

    Sentences meet by their sent_id; those left on both sides by their order among the left ones.
    """
    sides = []
    for rows in (target, source):
        s = rows.select("doc_id", "sent_no", F.nullif(F.trim("sent_id"), F.lit("")).alias("sent_id")).distinct()
        # of sentences with one id the first counts
        first = F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("sent_no")) == 1
        sides.append(s.withColumn("sent_id", F.when(first, F.col("sent_id"))))
    t_, s_ = sides
    known = lambda rows, name: rows.where("sent_id is not null").select("doc_id", "sent_id", F.col("sent_no").alias(name))
    named = beside(known(t_, "t_no"), known(s_, "s_no"), ("doc_id", "sent_id")).where("s_no is not null").drop("sent_id")
    left = lambda rows, key: beside(rows.select("doc_id", "sent_no"), named.select("doc_id", F.col(key).alias("sent_no"), F.lit(True).alias("met")), ("doc_id", "sent_no")).where("met is null")
    nth = lambda rows, key: left(rows, key).select("doc_id", F.col("sent_no").alias(key), F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_no")).alias("nth"))
    rest = beside(nth(t_, "t_no"), nth(s_, "s_no"), ("doc_id", "nth")).where("s_no is not null")
    pairs = named.unionByName(rest.select("doc_id", "t_no", "s_no"))
    tokens = source.select("doc_id", F.col("sent_no").alias("s_no"), "tok_no", F.nullif("tokid", F.lit("")).alias("source_id"))
    ids = beside(tokens, pairs, ("doc_id", "s_no")).where("t_no is not null").select("doc_id", F.col("t_no").alias("sent_no"), "tok_no", "source_id")
    joined = beside(target, ids, ("doc_id", "sent_no", "tok_no"))
    return joined.withColumn("tokid", F.coalesce(F.nullif("tokid", F.lit("")), "source_id")).select(*target.columns)


def referenced(tokens: DataFrame, sentences: DataFrame, attribute: str = "corresp") -> DataFrame:
    """Tokens moved into the sentences that name them: sentences(doc_id, sent_no, corresp: blank-separated #ids); others stay where they are."""
    named = sentences.select("doc_id", F.col("sent_no").alias("new_no"), F.posexplode(F.split(F.trim(F.coalesce(attribute, F.lit(""))), r"\s+")).alias("place", "ref")).where("ref <> ''")
    named = named.select("doc_id", "new_no", "place", F.regexp_replace("ref", "^#", "").alias("tokid")).groupBy("doc_id", "tokid").agg(F.min(F.struct("new_no", "place")).alias("at"))
    joined = tokens.join(named, ["doc_id", "tokid"], "left")
    moved = joined.select(*(F.coalesce("at.new_no", "sent_no").alias("sent_no") if c == "sent_no" else F.coalesce("at.place", "tok_no").alias("tok_no") if c == "tok_no" else F.col(c) for c in tokens.columns))
    return moved


def spans_meet(tokens: DataFrame, blocks: DataFrame, width: int = 512) -> DataFrame:
    """tokens(doc_id, char_start, char_end), blocks(doc_id, block, start, end): the token rows with each block they overlap. A range join by cells."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)))
    left = tokens.withColumn("cell", cells("char_start", "char_end"))
    right = blocks.select("doc_id", "block", "start", "end").withColumn("cell", cells("start", "end"))
    met = left.join(right, ["doc_id", "cell"]).where("char_start < end and start < char_end")
    # a pair that shares several cells counts in the first of them
    first = F.greatest(F.floor(F.col("char_start") / width), F.floor(F.col("start") / width)) == F.col("cell")
    return met.where(first).drop("cell")
