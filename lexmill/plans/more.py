"""Further queries: lexica, tagsets, reports, ids, blocks, writers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import evaluation, language, lexicon, model, reports, training
from lexmill.operators import tokens as tk
from lexmill.operators.joins import beside, salted_join
from lexmill.plans.catalog import _CASE, _MWTS, _RESULTS, _long, _model, _parked_vocab, _results, query
from lexmill.plans.fixtures import dealt_gold, docs, gold, predicted, split_words, sql
from lexmill.sources import conllu
from lexmill.streaming import sessions

PLACE = tk.PLACE

#: A small positional tagset: nouns and names with gender and number, verbs with mood and tense, adverbs without positions.
TAGSET_XML = """<tagset><positions>
<item key="N"><multi><item key="NP"/></multi><item pos="1" display="gender"><item key="M" display="masculine"/><item key="F" display="feminine"/><item key="0"/></item>
<item pos="2" display="number"><item key="S" display="singular"/><item key="P" display="plural"/></item></item>
<item key="V"><item pos="1" display="mood"><item key="I" display="indicative"/><item key="S" display="subjunctive"/></item><item pos="2" display="tense"><item key="P" display="present"/><item key="F" display="future"/></item></item>
<item key="R"/></positions></tagset>"""
_TAG = """case upos when 'NOUN' then 'N' || case when length(form) % 3 = 0 then '0' when length(form) % 3 = 1 then 'M' else 'F' end || case when form like '%s' then 'P' else 'S' end || '0'
    when 'PROPN' then 'NP' || case when length(form) % 2 = 0 then 'M' else 'F' end || 'S' when 'VERB' then 'V' || case when length(form) % 2 = 0 then 'I' else 'S' end || case when form like '%d' then 'F' else 'P' end when 'ADV' then 'RG' else 'Q' || (length(form) % 3) end"""


def _positional(spark, d):
    return gold(spark, d).withColumn("xpos", F.expr(_TAG))


@query(sql("g", f"""select distinct x as xpos, case x[1] when 'N' then case x[2] when 'P' then 'PROPN' else 'NOUN' end when 'V' then 'VERB' when 'R' then 'ADV' else 'X' end as upos,
    case when x[:2] = 'NP' then 'Gender=' || case x[3] when 'M' then 'Masc' else 'Fem' end || '|Number=Sing'
    when x[1] = 'N' then case x[2] when 'M' then 'Gender=Masc|' when 'F' then 'Gender=Fem|' else '' end || 'Number=' || case x[3] when 'P' then 'Plur' else 'Sing' end
    when x[1] = 'V' then 'Mood=' || case x[2] when 'I' then 'Ind' else 'Sub' end || '|Tense=' || case x[3] when 'F' then 'Fut' else 'Pres' end else '_' end as feats from (select {_TAG} as x from g)"""))
def positional_tags(spark, d):
    tagset = spark.createDataFrame(lexicon.tagset_rows(TAGSET_XML), lexicon.TAGSET)
    return lexicon.positional_tags(_positional(spark, d), tagset)


@query(sql("g", f"select {_TAG} as xpos, count(*) as cnt from g group by 1"))
def xpos_frequencies(spark, d):
    return lexicon.xpos_frequencies(_positional(spark, d))


@query(sql("v", """, l as (select distinct form, lemma from v where length(form) > 2), r as (select upos, 'Number=Plur' as feats, count(*) as n from v group by 1)
    select form, lower(lemma) as lemma, k.upos, k.xpos, k.feats, 1::bigint as cnt from l, (values (0, 'NOUN', 'Number=Plur', 'NP2'), (1, 'VERB', 'Number=Sing|Person=3|Tense=Pres', 'V3'), (2, '_', '_', '_')) k(m, upos, feats, xpos) where m = length(form) % 3""".replace(", l as (select distinct", ", le as (select distinct").replace("from l, (values", "from le, (values")))
def unimorph_lexicon(spark, d):
    bundle = "case length(form) % 3 when 0 then 'N;PL' when 1 then 'V;3;SG;PRS' else 'Q' end"
    entries = _parked_vocab(spark, d).where("length(form) > 2").select("form", "lemma").distinct()
    lines = entries.select(F.concat_ws("\t", "lemma", "form", F.expr(bundle)).alias("value")).unionByName(spark.createDataFrame([("# comment",), ("x",), ("",)], "value string"))
    readings = spark.createDataFrame([("NP2", "NOUN", "Case=Nom|Number=Plur", 5), ("NP1", "NOUN", "Gender=Fem|Number=Plur", 4), ("V3", "VERB", "Number=Sing|Person=3|Tense=Pres", 1), ("V9", "VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Pres", 9)], "xpos string, upos string, feats string, cnt long")
    return lexicon.parsed_unimorph(lines, readings=readings)


@query(sql("v", "select upos as tag, round((sum(cnt) + 0.1) / ((select sum(cnt) from v) + 0.1 * (select count(distinct upos) from v)), 9) as probability from v group by 1"))
def default_emissions(spark, d):
    return lexicon.default_emissions(_parked_vocab(spark, d)).withColumn("probability", F.round("probability", 9))


@query(sql("v", """, k as (select form, upos, sum(cnt) as cnt from v group by 1, 2), p as (select form as host, upos as host_upos, cnt / sum(cnt) over (partition by form) as hp from k),
    c as (select * from (values ('se', 'right', 'PRON', 0.6), ('lo', 'right', 'PRON', 0.4), ('re', 'left', 'ADV', 0.5)) c(clitic, side, upos, prob)),
    w as (select distinct form || 'se' as form from v union select distinct form || 'lo' from v union select distinct 're' || form from v)
    select w.form, host, host_upos, clitic, side, c.upos, round(prob * hp, 9) as score from w join c on (side = 'right' and ends_with(w.form, clitic) or side = 'left' and starts_with(w.form, clitic))
    join p on p.host = case when side = 'right' then left(w.form, length(w.form) - 2) else substr(w.form, 3) end where w.form not in (select form from k) and host_upos in ('NOUN', 'VERB')
    qualify row_number() over (partition by w.form order by prob * hp desc, length(clitic) desc, side, host_upos, c.upos) = 1"""))
def clitic_split(spark, d):
    vocab = _parked_vocab(spark, d)
    clitics = spark.createDataFrame([("se", "right", "PRON", 0.6), ("lo", "right", "PRON", 0.4), ("re", "left", "ADV", 0.5)], "clitic string, side string, upos string, prob double")
    words = vocab.select(F.explode(F.array(F.concat("form", F.lit("se")), F.concat("form", F.lit("lo")), F.concat(F.lit("re"), "form"))).alias("form"))
    return lexicon.split_clitics(words, clitics, vocab, ("NOUN", "VERB")).withColumn("score", F.round("score", 9))


_HALVES = "form[:length(form) // 2] || '+' || form[length(form) // 2 + 1:]"


def _halves(spark, d):
    half = F.floor(F.length("form") / 2).cast("int")
    return gold(spark, d).where("length(form) >= 6 and length(form) % 3 = 0").select("form", F.array(F.substring("form", F.lit(1), half), F.substring("form", half + 1, F.length("form"))).alias("parts"))


@query(sql("g", f"select form, {_HALVES} as parts, count(*) as cnt from g where length(form) >= 6 and length(form) % 3 = 0 group by 1, 2"))
def mwt_parts(spark, d):
    return training.mwt_counts(_halves(spark, d))


@query(sql("g", f"select distinct form, case when length(form) >= 6 and length(form) % 3 = 0 then {_HALVES} end as parts from g"))
def contraction_split(spark, d):
    return training.best_split(gold(spark, d).select("form").distinct(), training.mwt_counts(_halves(spark, d)))


@query(sql("mw", f", {_MWTS} select doc_id, form as mwt_form, count(*) as n from im group by 1, 2"))
def conllu_ranges(spark, d):
    """Multiword tokens written as range lines and read again."""
    rows = split_words(dealt_gold(spark, d))
    mwts = tk.implicit_mwts(rows).select(*tk.SENTENCE, F.explode(F.sequence("mwt_start", "mwt_end")).alias("tok_no"), (F.col("mwt_start") + 1).alias("mwt_start"), (F.col("mwt_end") + 1).alias("mwt_end"), F.col("form").alias("mwt_form"))
    empty = [F.lit("_").alias(c) for c in ("lemma", "xpos", "feats", "deprel")]
    written = conllu.documents(beside(rows.select("*", *empty, F.lit(0).alias("head")), mwts, PLACE))
    return conllu.parsed(written).where("id = mwt_start").groupBy("doc_id", "mwt_form").agg(F.count("*").alias("n"))


@query(sql("sp", "select doc_id, sha256(string_agg(s, chr(10) order by line_no, sent_no)) as text from (select doc_id, line_no, sent_no, string_agg(form, ' ' order by tok_no) as s from sp group by 1, 2, 3) group by 1"))
def tokenized_dump(spark, d):
    return conllu.dumped(tk.with_space_after(gold(spark, d)), "tokenized").select("doc_id", F.sha2("text", 256).alias("text"))


@query(sql("pr", "select 'lemma' as metric, count(*) filter (p_lemma = lemma) as correct, count(*) as total from pr union all select 'upos', count(*) filter (p_upos = upos), count(*) from pr"))
def metrics_file(spark, d):
    g = dealt_gold(spark, d)
    aligned = evaluation.same_place(g, predicted(g), ("form", "upos", "lemma"))
    payload = conllu.metrics_json(evaluation.metrics(aligned, ("upos", "lemma")))
    read = payload.select(F.explode(F.from_json("payload", "map<string, struct<correct: bigint, total: bigint, accuracy: double>>")).alias("metric", "m"))
    return read.where("metric <> 'tokenization'").select("metric", "m.correct", "m.total")


# --- reports --------------------------------------------------------------------------------------------------


@query(f"with {_RESULTS} select count(*) as benchmarks, count(distinct (backend, model)) as models, count(distinct language) as languages, count(distinct treebank) as treebanks from r")
def bench_summary(spark, d):
    return reports.summary(_results(spark, d))


@query(f"with {_RESULTS} select language, treebank, backend, model, size from r where language in ('en', 'de') and backend = 'b1'")
def bench_filtered(spark, d):
    return reports.narrowed(_results(spark, d), ("EN", "de"), ("B1",), ("AUTO",)).select("language", "treebank", "backend", "model", "size")


@query(f"with {_RESULTS} select language, string_agg(distinct backend, ',' order by backend) as backends, count(distinct (backend, model)) as n_models from r group by 1")
def language_report(spark, d):
    return reports.language_report(_results(spark, d))


@query(f"with {_RESULTS} select distinct language, treebank as path from r where language = 'de' order by path limit 3")
def discovery_limit(spark, d):
    return reports.discovered(_results(spark, d).select("language", F.col("treebank").alias("path")).distinct(), "DE", 3)


@query(sql("g", """select field, name, upos, treebank, count(*) as cnt from (select 'UPOS' as field, upos as name, upos, lang as treebank from g union all
    select 'FEATS', split_part(p, '=', 1), upos, lang from (select upos, lang, unnest(string_split(feats, '|')) as p from g)) group by 1, 2, 3, 4"""))
def tag_usage(spark, d):
    return reports.tag_usage(gold(spark, d), "lang")


@query("""with s as (select user_id as session_id, min(ts) as started, max(ts) as seen, case when max(user_id) % 4 = 0 then 'failed' else 'running' end as status from events group by 1), m as (select max(seen) as now from s)
    select session_id, case when status = 'running' and seen < now - interval 6 hour then 'completed' else status end as status, row_number() over (order by started desc, session_id) as place from s, m""")
def session_list(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started"), F.max("ts").alias("seen")).withColumn("status", F.when(F.col("session_id") % 4 == 0, "failed").otherwise("running"))
    now = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    found = reports.sessions(rows, f"timestamp '{now}'", "INTERVAL 6 HOUR", include_completed=True)
    return found.select("session_id", "status", F.row_number().over(Window.orderBy(F.desc("started"), "session_id")).cast("long").alias("place"))


@query("""with e as (select user_id::varchar as session_id, ts as seen_at, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status from events where user_id is not null and ts is not null),
    f as (select *, status <> 'running' as ends from e), g as (select *, coalesce(seen_at - lag(seen_at) over w > interval 6 hour or lag(ends) over w, true) as fresh from f window w as (partition by session_id order by seen_at, ends, status)),
    r as (select *, sum(fresh::int) over (partition by session_id order by seen_at, ends, status rows unbounded preceding) as run from g),
    s as (select session_id, min(seen_at) as started, max(seen_at) as seen, count(*) as events, coalesce(max(status) filter (ends), 'running') as status from r group by session_id, run)
    select session_id, epoch_us(started) as started_us, epoch_us(seen) as seen_us, events, case status when 'running' then 'completed' else status end as status from s where status <> 'running' or seen < (select max(seen_at) from e) - interval 6 hour""")
def ended_sessions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    over = sessions.ended(events.select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), status.alias("status")), 6 * 3600)
    return over.select("session_id", F.unix_micros("started").alias("started_us"), F.unix_micros("seen").alias("seen_us"), "events", "status")


@query("select distinct source, regexp_replace(source, '[0-9]+', '') || lpad(regexp_extract(source, '[0-9]+'), 20, '0') as k from documents")
def natural_sort_keys(spark, d):
    return docs(spark, d).select("source").distinct().withColumn("k", reports.natural_key(F.col("source")))


@query(sql("g", "select count(*) as words, 0::bigint as oov from g"))
def tagger_stats(spark, d):
    return reports.tagging_stats(model.tagged(_model(spark, d), dealt_gold(spark, d).select(*PLACE, "form"))).select("words", "oov")




@query(sql("pr", f""", f as (select form as ff, count(*) as fr from g group by 1), e as (select upos as gold_upos, {_CASE} as wcase, (p_lemma <> lemma)::bigint as w,
        case when tok_no = 0 then 'first' when tok_no = n - 1 then 'last' when tok_no * 3 < n then 'early' when tok_no * 3 < n * 2 then 'middle' else 'late' end as position,
        case when fr < 5 then '1-4' when fr < 20 then '5-19' when fr < 100 then '20-99' else '100+' end as frequency from (select *, count(*) over (partition by doc_id, line_no, sent_no) as n from pr) join f on ff = form)
    select case when grouping(position) = 0 then 'position' when grouping(frequency) = 0 then 'frequency' when grouping(wcase) = 0 then 'wcase' else 'all' end as grouping,
        case when grouping(position) = 0 then position when grouping(frequency) = 0 then frequency when grouping(wcase) = 0 then wcase else '' end as value, count(*) as total, sum(w)::bigint as errors from e group by grouping sets ((), (position), (frequency), (wcase))"""))
def lemma_errors(spark, d):
    """Wrong lemmas by place in the sentence, frequency of the form and its case."""
    g = dealt_gold(spark, d)
    freq = gold(spark, d).groupBy("form").agg(F.count("*").alias("fr"))
    rows = evaluation.same_place(g, predicted(g), ("lemma",)).withColumn("n", F.count("*").over(Window.partitionBy(*tk.SENTENCE))).withColumn("row", F.xxhash64(*PLACE))
    rows = salted_join(rows, freq, "form", "row", counted="fr").withColumn("position", t.position_bucket(F.col("tok_no"), F.col("n"))).withColumn("frequency", t.frequency_bucket(F.col("fr"))).withColumn("wcase", t.case_class(F.col("form")))
    return evaluation.error_report(rows, F.col("pred_lemma") != F.col("lemma"), "position", "frequency", "wcase")


# --- ids, blocks, names ---------------------------------------------------------------------------------------


@query(sql("t", "select doc_id, sent_no, tok_no, case when sent_no % 5 = 0 then 'own' else 'w' || sent_no || '-' || tok_no end as tokid from (select doc_id, dense_rank() over (partition by doc_id order by line_no, sent_no) as sent_no, tok_no from t)"))
def token_ids(spark, d):
    rows = dealt_gold(spark, d).withColumn("sent_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("line_no", "sent_no")))
    sent_id = F.when(F.col("sent_no") % 3 == 0, None).otherwise(F.concat(F.lit("s"), "sent_no"))
    source = rows.select("doc_id", "sent_no", sent_id.alias("sent_id"), "tok_no", F.concat(F.lit("w"), "sent_no", F.lit("-"), "tok_no").alias("tokid"))
    target = source.withColumn("tokid", F.when(F.col("sent_no") % 5 == 0, "own"))
    return tk.with_ids_of(target, source).select("doc_id", *_long("sent_no", "tok_no"), "tokid")


@query(sql("sp", """, o as (select *, start + length(form) as stop from (select *, coalesce(sum(length(form) + case when space_after = false then 0 else 1 end) over (partition by doc_id, line_no, sent_no order by tok_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from sp)),
    p as (select o.doc_id, b, start, stop from o, range(0, 40) r(b) where line_no = 0 and sent_no = 0 and start < b * 50 + 50 and b * 50 < stop) select doc_id, b as block, count(*) as n from p group by 1, 2"""))
def tokens_in_blocks(spark, d):
    """Tokens of the first sentences over blocks of 50 characters."""
    rows = tk.with_offsets(tk.with_space_after(gold(spark, d).where("line_no = 0 and sent_no = 0")))
    blocks = rows.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("block")).select("doc_id", "block", (F.col("block") * 50).alias("start"), (F.col("block") * 50 + 50).alias("end"))
    return tk.spans_meet(rows, blocks, 64).groupBy("doc_id", "block").agg(F.count("*").alias("n"))


@query("""select lang as q, k.iso, k.name, k.how, count(*) as n from documents join (values ('en', 'en', 'English', 'code'), ('de', 'de', 'German', 'code'), ('fr', null, null, 'none'), ('es', 'es', 'Spanish', 'code')) k(q, iso, name, how) on q = lang group by 1, 2, 3, 4""")
def language_codes(spark, d):
    listed = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("es", "spa", "Spanish")], "iso1 string, iso3 string, name string")
    return language.resolved(docs(spark, d).select(F.col("lang").alias("q")), listed).groupBy("q", "iso", "name", "how").agg(F.count("*").alias("n"))


@query(r"select doc_id, regexp_replace(text, '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{FEFF}]', '', 'g') as text from documents")
def sanitized_text(spark, d):
    return docs(spark, d).select("doc_id", t.sanitized(F.col("text")).alias("text"))


@query("select doc_id, 'UTF-8' as encoding, text from documents")
def decoded_bytes(spark, d):
    return docs(spark, d).select("doc_id", t.decoded(F.col("text").cast("binary")).alias("x")).select("doc_id", "x.encoding", "x.text")
