"""Name -> query and name -> SQL for the engine's own operators. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import kernels
from lexmill.functions import text as t
from lexmill.operators import blocks, evaluation, language, lexicon, model, reports, stages, tagging, training, tuning
from lexmill.operators import tokens as tk
from lexmill.operators.joins import beside, salted_join
from lexmill.plans.fixtures import dealt_gold, dealt_tok, docs, gold, predicted, split_words, sql, tok
from lexmill.sources import conllu, html, teitok, validation
from lexmill.sources.shared import park

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _long(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


PLACE = ("doc_id", "line_no", "sent_no", "tok_no")

# --- text -----------------------------------------------------------------------------------------------------


@query(sql("s", "select doc_id, line_no, sent_no, sent from s"))
def sentence_split(spark, d):
    return tk.sentence_table(docs(spark, d)).select("doc_id", *_long("line_no", "sent_no"), "sent")


@query(sql("t", "select lang, form, count(*) as n from t group by 1, 2"))
def tokenize_forms(spark, d):
    return tok(spark, d).groupBy("lang", "form").agg(F.count("*").alias("n"))


@query(sql("l", r"""select x as form, count(*) as n from (select unnest(case when regexp_matches(w, '^.*[^.!?][.!?]+$') then [regexp_extract(w, '^(.*[^.!?])([.!?]+)$', 1), regexp_extract(w, '^(.*[^.!?])([.!?]+)$', 2)] else [w] end) as x
    from (select unnest(list_filter(regexp_split_to_array(line, '\s+'), lambda z: z <> '')) as w from l)) group by 1"""))
def whitespace_tokens(spark, d):
    return tk.line_table(docs(spark, d)).select(F.explode(t.whitespace_tokens(F.col("line"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query(r"""select doc_id, generate_subscripts(y, 1) - 1 as sent_no, unnest(y) as sent from (select doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]+) ', '\1' || chr(10), 'g'), chr(10)), lambda z: z <> '') as y from documents)""")
def punct_collapse_segment(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(t.collapsed_sentences(F.col("text"))).alias("sent_no", "sent")).select("doc_id", *_long("sent_no"), "sent")


@query(sql("l", r"select x as form, count(*) as n from (select unnest(regexp_extract_all(line, '([\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])', 1)) as x from l) group by 1"))
def punctuation_apart(spark, d):
    return tk.line_table(docs(spark, d)).select(F.explode(t.punctuation_apart(F.col("line"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query(sql("s", r"select x as form, count(*) as n from (select unnest(regexp_extract_all(sent, '([A-Za-z0-9\x{80}-\x{10FFFF}]+(?:[''-][A-Za-z0-9\x{80}-\x{10FFFF}]+)*|[\x21-\x7E])', 1)) as x from s) group by 1"))
def ascii_tokens(spark, d):
    return tk.sentence_table(docs(spark, d)).select(F.explode(t.ascii_tokens(F.col("sent"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query()
def quoted_sentences(spark, d):
    return tk.line_table(docs(spark, d)).select("doc_id", *_long("line_no"), F.posexplode(kernels.quoted_sentences(F.col("line"))).alias("sent_no", "sent")).select("doc_id", "line_no", *_long("sent_no"), "sent")


@query("select doc_id, sha256(nfc_normalize(text)) as nfc, length(nfc_normalize(text)) as chars from documents")
def nfc_normalize(spark, d):
    n = kernels.normalized("NFC")(F.col("text"))
    return docs(spark, d).select("doc_id", n.alias("n")).select("doc_id", F.sha2("n", 256).alias("nfc"), F.length("n").cast("long").alias("chars"))


@query()
def nfd_normalize(spark, d):
    return docs(spark, d).select("doc_id", kernels.normalized("NFD")(F.col("text")).alias("text")).select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("nfd"))


@query(sql("sp", "select doc_id, line_no, sent_no, tok_no, form, space_after from sp"))
def space_after_flags(spark, d):
    return tk.with_space_after(tok(spark, d)).select("doc_id", *_long("line_no", "sent_no", "tok_no"), "form", "space_after")


@query(sql("sp", "select doc_id, line_no, sent_no, rtrim(string_agg(form || case when space_after = false then '' else ' ' end, '' order by tok_no)) as text from sp group by 1, 2, 3"))
def sentence_rebuild(spark, d):
    return tk.rebuilt(tk.with_space_after(tok(spark, d))).select("doc_id", *_long("line_no", "sent_no"), "text")


@query(sql("sp", """select doc_id, line_no, sent_no, tok_no, start as char_start, start + length(form) as char_end from (select *, coalesce(sum(length(form) + case when space_after = false then 0 else 1 end)
    over (partition by doc_id, line_no, sent_no order by tok_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from sp)"""))
def token_offsets(spark, d):
    return tk.with_offsets(tk.with_space_after(tok(spark, d))).select("doc_id", *_long("line_no", "sent_no", "tok_no", "char_start", "char_end"))


@query()
def token_locate(spark, d):
    return tk.located(tok(spark, d), tk.sentence_table(docs(spark, d))).select("doc_id", *_long("line_no", "sent_no", "tok_no"), "form", *_long("char_start"))


@query(sql("t", "select doc_id, line_no, sent_no, e - n as tok_start, e as tok_end from (select *, (sum(n) over (partition by doc_id order by line_no, sent_no))::bigint as e from (select doc_id, line_no, sent_no, count(*) as n from t group by 1, 2, 3))"))
def sentence_bounds(spark, d):
    return tk.sentence_bounds(tok(spark, d)).select("doc_id", *_long("line_no", "sent_no"), *_long("tok_start", "tok_end"))


@query(sql("t", """select doc_id, line_no, sent_no, tok_no, array_to_string(list_filter([lag(form, 2) over w, lag(form) over w, '<' || form || '>', lead(form) over w, lead(form, 2) over w], lambda z: z is not null), ' ') as context
    from t window w as (partition by doc_id, line_no, sent_no order by tok_no)"""))
def context_window(spark, d):
    return tk.context(tok(spark, d)).select("doc_id", *_long("line_no", "sent_no", "tok_no"), "context")


@query(r"""select doc_id, case when regexp_matches(substr(text, 1, 4096), '<tok[\s>]|<TEI[\s>]') then 'teitok' when regexp_matches(substr(text, 1, 4096), '(?m)^# ?(?:sent_id|text|newdoc|newpar|global\.columns)\b')
    or length(substr(text, 1, 4096)) - length(replace(substr(text, 1, 4096), chr(9), '')) >= 10 then 'conllu' else 'raw' end as format from documents""")
def detect_format(spark, d):
    return docs(spark, d).select("doc_id", t.detected_format(F.col("text")).alias("format"))


@query(sql("t", r"select k, count(*) as n from (select case when regexp_replace(lower(form), '[^\p{L}\p{N}]', '', 'g') <> '' then regexp_replace(lower(form), '[^\p{L}\p{N}]', '', 'g') else lower(form) end as k from t) group by 1"))
def align_key(spark, d):
    return tok(spark, d).select(t.align_key(F.col("form")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query(r"""select doc_id, regexp_replace(text, '(\p{L})[-\x{00AD}\x{2010}][ \t]*\n[ \t]*(\p{Ll})', '\1\2', 'g') as text from documents""")
def hyphen_rejoin(spark, d):
    return docs(spark, d).select("doc_id", t.rejoined(F.col("text")).alias("text"))


@query()
def html_plain_text(spark, d):
    return html.plain_pages(spark.read.parquet(f"{d}/pages.parquet"))


@query("select props_type, feats, upos, count(*) as n from (select event_type as props_type, case event_id % 4 when 0 then 'V;IND;SG;3;PRS' when 1 then 'N;PL;NOM' when 2 then 'ADJ;X' else '' end as f from events), (values ('V;IND;SG;3;PRS', 'VERB', 'Mood=Ind|Number=Sing|Person=3|Tense=Pres'), ('N;PL;NOM', 'NOUN', 'Case=Nom|Number=Plur'), ('ADJ;X', 'ADJ', '_'), ('', '_', '_')) m(k, upos, feats) where f = k group by 1, 2, 3")
def unimorph_to_ud(spark, d):
    bundle = F.expr("case event_id % 4 when 0 then 'V;IND;SG;3;PRS' when 1 then 'N;PL;NOM' when 2 then 'ADJ;X' else '' end")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("props_type"), t.unimorph_to_ud(bundle).alias("u"))
    return rows.groupBy("props_type", "u.feats", "u.upos").agg(F.count("*").alias("n"))


@query(sql("g", "select f, count(*) as n from (select case when feats like '%|%' then feats else feats end as f from g) group by 1"))
def feats_normalize(spark, d):
    shuffled = F.array_join(F.reverse(F.split("feats", r"\|")), "|")
    return gold(spark, d).select(t.feats_normal(F.concat(shuffled, F.lit("|junk"))).alias("f")).groupBy("f").agg(F.count("*").alias("n"))


# --- multiword tokens, projections ----------------------------------------------------------------------------


_PUNCT = r"(upos = 'PUNCT' or regexp_matches(form, '^[!-/:-@\[-`{-~]$'))"
#: Runs without blanks, and of each the first tail that counts as a multiword token.
_MWTS = rf"""rn as (select doc_id, line_no, sent_no, run, list({{'n': tok_no, 'form': form, 'p': {_PUNCT}}} order by tok_no) as ms from
        (select *, sum(coalesce(before, true)::int) over (partition by doc_id, line_no, sent_no order by tok_no) as run from (select *, lag(space_after) over (partition by doc_id, line_no, sent_no order by tok_no) as before from mw)) group by 1, 2, 3, 4 having count(*) > 1),
    tl as (select doc_id, line_no, sent_no, run, i, ms[i:] as ms, len(list_filter(ms[i:], lambda m: m.p)) as marks from rn, unnest(range(1, len(ms))) u(i)),
    im as (select doc_id, line_no, sent_no, ms[1].n as mwt_start, ms[-1].n as mwt_end, list_reduce(list_transform(ms, lambda m: m.form), lambda a, b: a || b) as form from tl
        where marks = 0 or (len(ms) = 2 and ms[2].p and contains(ms[2].form, '''')) or (not ms[1].p and not ms[-1].p and len(list_filter(ms, lambda m: m.p and m.form not in ('-', '–', '—'))) = 0)
        qualify row_number() over (partition by doc_id, line_no, sent_no, run order by i) = 1)"""


@query(sql("mw", f", {_MWTS} select * from im"))
def implicit_mwt(spark, d):
    return tk.implicit_mwts(split_words(gold(spark, d))).select("doc_id", *_long("line_no", "sent_no"), *_long("mwt_start", "mwt_end"), "form")


_PAIRED = rf"""cp as (select doc_id, line_no, sent_no, tok_no as first, next_no as second, form || next_form as form from (select *, row_number() over (partition by doc_id, line_no, sent_no, chain order by tok_no) as rank from
    (select *, sum(case when joins then 0 else 1 end) over (partition by doc_id, line_no, sent_no order by tok_no) as chain from (select *, coalesce(space_after = false and not punct and not lead(punct) over w, false) as joins, lead(form) over w as next_form, lead(tok_no) over w as next_no
    from (select *, {_PUNCT} as punct from mw) window w as (partition by doc_id, line_no, sent_no order by tok_no))) where joins) where rank % 2 = 1)"""


@query(sql("mw", f", {_PAIRED} select * from cp"))
def contraction_pairs(spark, d):
    return tk.contraction_pairs(split_words(gold(spark, d))).select("doc_id", *_long("line_no", "sent_no"), *_long("first", "second"), "form")


_HYPHENATED = r"contains(form, '-') and length(form) > 1"


@query(sql("g", r"select upos, part as form, count(*) as n from (select upos, unnest(case when contains(form, '-') and length(form) > 1 then string_split(form, '-') else [form] end) as part from g) group by 1, 2"))
def atomic_tokens(spark, d):
    parts = F.when(F.expr(_HYPHENATED), F.transform(F.split("form", "-"), lambda x: F.struct(x.alias("form"), F.col("upos").alias("upos"))))
    return tk.atomic(gold(spark, d).withColumn("parts", parts)).groupBy("upos", "form").agg(F.count("*").alias("n"))


@query(sql("g", "select form, '_' as upos, '_' as lemma, '_' as feats, count(*) as n from g group by 1"))
def detag(spark, d):
    return tk.detagged(gold(spark, d)).groupBy("form", "upos", "lemma", "feats").agg(F.count("*").alias("n"))


@query(sql("mw", f""", {_MWTS}, c as (select mw.*, im.mwt_start, im.form as mwt_form from mw left join im on im.doc_id = mw.doc_id and im.line_no = mw.line_no and im.sent_no = mw.sent_no and mw.tok_no between mwt_start and mwt_end)
    select doc_id, min(tok_no)::bigint as tok_no, line_no, sent_no, case when length(max(mwt_form)) % 4 > 0 then max(mwt_form) else string_agg(form, '' order by tok_no) end as form, '_' as upos, arg_max(case when space_after is null then 'end' when space_after then 'yes' else 'no' end, tok_no) as space from c group by doc_id, line_no, sent_no, coalesce(mwt_start, tok_no)"""))
def detag_merged(spark, d):
    """Tokens without annotation, multiword tokens merged; every fourth of those has no form of its own."""
    g = split_words(dealt_gold(spark, d))
    mwts = tk.implicit_mwts(g).withColumn("form", F.when(F.length("form") % 4 > 0, F.col("form")).otherwise("_"))
    space = F.when(F.col("space_after").isNull(), "end").when(F.col("space_after"), "yes").otherwise("no")
    return tk.merged_detagged(g, mwts).select("doc_id", *_long("tok_no", "line_no", "sent_no"), "form", "upos", space.alias("space"))


@query(sql("g", "select upos, '_' as lemma, '_' as deprel, count(*) as n from g group by 1"))
def task_filter(spark, d):
    return tk.keep_tasks(gold(spark, d), ("tag",)).groupBy("upos", "lemma", "deprel").agg(F.count("*").alias("n"))


@query(sql("g", "select doc_id, true as tag, bool_or(lemma not in ('_', '')) as lemmatize, true as parse from g group by 1"))
def task_flags(spark, d):
    return tk.task_flags(gold(spark, d), "doc_id").select("doc_id", "tag", "lemmatize", "parse")


@query(sql("g", "select upos, count(*) as n from g where (doc_id, line_no, sent_no) in (select (doc_id, line_no, sent_no) from g where upos = 'VERB') group by 1"))
def required_annotations(spark, d):
    rows = gold(spark, d).withColumn("verb", F.when(F.col("upos") == "VERB", "x").otherwise("_"))
    return tk.with_annotations(rows, ("verb", "form")).groupBy("upos").agg(F.count("*").alias("n"))


@query(sql("g", "select coalesce(case when length(form) > 4 then lower(form) end, form) as form, count(*) as n from g group by 1"))
def nlp_form(spark, d):
    return tk.with_nlp_form(gold(spark, d).withColumn("reg", F.when(F.length("form") > 4, F.lower("form")).otherwise("_"))).groupBy("form").agg(F.count("*").alias("n"))


# --- training -------------------------------------------------------------------------------------------------


@query(sql("v", "select form, lemma, upos, xpos, feats, cnt from v"))
def vocab_counts(spark, d):
    return training.vocabulary(gold(spark, d))


@query(sql("g", "select prev, tag, count(*) as cnt from (select lag(upos) over (partition by doc_id, line_no, sent_no order by tok_no) as prev, upos as tag from g) where prev is not null group by 1, 2"))
def transition_counts(spark, d):
    return training.transitions(gold(spark, d), starts=False)


@query(sql("g", "select 'START' as prev, upos as tag, count(*) as cnt from g where tok_no = 0 group by 2"))
def start_counts(spark, d):
    return training.transitions(gold(spark, d)).where("prev = 'START'")


_CASE = r"case when regexp_matches(form, '^\p{Lu}') and upper(form) = form and length(form) > 1 then 'UU' when regexp_matches(form, '^\p{Lu}') then 'Ul' when regexp_matches(form, '^\p{Ll}') then 'll' else '??' end"


@query(sql("g", f"select upos as tag, {_CASE} as wcase, count(*) as cnt from g group by 1, 2"))
def case_profile(spark, d):
    return training.case_profile(gold(spark, d))


@query(sql("v", "select (select count(*) from v) as entries, (select sum(cnt)::bigint from v) as tokens, (select count(distinct form) from t) as words, (select count(distinct (doc_id, line_no, sent_no)) from t) as sentences"))
def vocab_stats(spark, d):
    return training.vocabulary_stats(gold(spark, d))


_ENDINGS = "en as (select ending, tag, count(*) as types from (select tag, form[-n:] as ending from (select distinct form, lemma, upos as tag from v), range(1, 7) r(n) where n <= length(form)) group by 1, 2)"


@query(sql("v", "select ending, tag, count(*) as types from (select tag, substr(form, length(form) - n + 1) as ending from (select distinct form, lemma, upos as tag from v), range(1, 7) r(n) where n <= length(form)) group by 1, 2"))
def ending_counts(spark, d):
    return training.endings(training.vocabulary(gold(spark, d)))


@query(sql("g", "select upos as tag, count(distinct form) as types from g group by 1"))
def tag_type_counts(spark, d):
    return training.tag_types(gold(spark, d))


@query(sql("v", "select upos as tag, form, lemma, cnt from v qualify row_number() over (partition by upos order by cnt desc, form, lemma, xpos, feats) = 1"))
def top_entry_per_tag(spark, d):
    return training.top_entries(training.vocabulary(gold(spark, d)))


@query(sql("g", "select xpos, upos, feats, count(*) as cnt from g group by 1, 2, 3 qualify row_number() over (partition by xpos order by cnt desc, upos, feats) = 1"))
def tag_mapping_best(spark, d):
    return training.tag_map(gold(spark, d))


_MAP = "m as (select xpos, upos, feats, count(*) as cnt from g group by 1, 2, 3 qualify row_number() over (partition by xpos order by cnt desc, upos, feats) = 1)"


@query(sql("g", rf"""
    , {_MAP}, w as (select distinct case length(form) % 3 when 0 then xpos when 1 then lower(xpos) else xpos || '.7' end as xpos from g),
    k as (select lower(xpos) as low, upos, feats from m qualify row_number() over (partition by low order by cnt desc, xpos) = 1)
    select w.xpos, coalesce(e.upos, k.upos, b.upos) as upos, coalesce(e.feats, k.feats, b.feats) as feats, case when e.upos is not null then 'exact' when k.upos is not null then 'case' when b.upos is not null then 'bare' else 'none' end as how
    from w left join m e on e.xpos = w.xpos left join k on k.low = lower(w.xpos) left join m b on b.xpos = rtrim(w.xpos, '0123456789.-_:')"""))
def tag_map_fallback(spark, d):
    g = gold(spark, d)
    wanted = g.select(F.expr("case length(form) % 3 when 0 then xpos when 1 then lower(xpos) else concat(xpos, '.7') end").alias("xpos")).distinct()
    return training.map_tags(wanted, training.tag_map(g))


@query(sql("g", "select upos, feats, xpos, count(*) as cnt from g group by 1, 2, 3 qualify row_number() over (partition by upos, feats order by cnt desc, xpos) = 1"))
def tag_mapping_reverse(spark, d):
    return training.reverse_tag_map(gold(spark, d))


_REVERSE = "rv as (select upos, feats, xpos, count(*) as cnt from g group by 1, 2, 3 qualify row_number() over (partition by upos, feats order by cnt desc, xpos) = 1)"


@query(sql("g", f"""
    , {_REVERSE}, w as (select distinct upos, feats from g union select upos, split_part(feats, '|', 1) from g union select upos, '_' from g union select upos, 'Number=Plur' from g union select upos, 'Voice=Act' from g)
    select w.upos, w.feats, rv.xpos, rv.feats = w.feats as exact from w join rv on rv.upos = w.upos and (w.feats = '_' or list_has_all(string_split(rv.feats, '|'), string_split(w.feats, '|')))
    qualify row_number() over (partition by w.upos, w.feats order by rv.feats = w.feats desc, rv.cnt desc, rv.xpos) = 1"""))
def feats_subset_xpos(spark, d):
    g = gold(spark, d)
    own = g.select("upos", "feats").distinct()
    wanted = [own, own.withColumn("feats", F.substring_index("feats", "|", 1)), *(own.withColumn("feats", F.lit(x)) for x in ("_", "Number=Plur", "Voice=Act"))]
    return training.guess_xpos(reduce(DataFrame.unionByName, wanted).distinct(), g)


@query(sql("g", f"""
    , {_MAP}, {_REVERSE}, b as (select case when length(form) % 2 = 0 then '_' else upos end as upos, case when length(form) % 4 = 0 then '_' else feats end as feats, case when length(form) % 3 = 0 then '_' else xpos end as xpos from g),
    u as (select case when b.upos = '_' then coalesce(m.upos, '_') else b.upos end as upos, case when b.feats = '_' then coalesce(m.feats, '_') else b.feats end as feats, b.xpos from b left join m on m.xpos = b.xpos and b.xpos <> '_'),
    q as (select u.upos, u.feats, r.xpos from (select distinct upos, feats from u where xpos = '_') u join rv r on r.upos = u.upos and (u.feats = '_' or list_has_all(string_split(r.feats, '|'), string_split(u.feats, '|')))
        qualify row_number() over (partition by u.upos, u.feats order by r.feats = u.feats desc, r.cnt desc, r.xpos) = 1)
    select u.upos, u.feats, case when u.xpos = '_' then coalesce(q.xpos, '_') else u.xpos end as xpos, count(*) as n from u left join q on q.upos = u.upos and q.feats = u.feats and u.xpos = '_' group by 1, 2, 3"""))
def map_tags_both(spark, d):
    g = gold(spark, d)
    blank = lambda c, k: F.when(F.length("form") % k == 0, "_").otherwise(F.col(c)).alias(c)
    holes = g.select("form", blank("upos", 2), blank("feats", 4), blank("xpos", 3))
    return training.with_mapped_tags(holes, g, "both").groupBy("upos", "feats", "xpos").agg(F.count("*").alias("n"))


@query(sql("g", """select field, name, value, count(*) as cnt from (select 'UPOS' as field, '' as name, upos as value from g union all
    select 'FEATS', split_part(p, '=', 1), split_part(p, '=', 2) from (select unnest(string_split(feats, '|')) as p from g)) group by 1, 2, 3"""))
def ud_inventory(spark, d):
    return training.ud_inventory(gold(spark, d))


@query(sql("sp", """select 'MISC' as field, 'SpaceAfter' as name, count(*) as cnt from sp where not space_after having count(*) > 0 union all select 'DOC', 'Genre', count(distinct doc_id) from g
    union all select unnest(['DOC', 'SENT']), 'topic', count(distinct (doc_id, line_no)) from g union all select 'SENT', unnest(['sent_id', 'text']), count(distinct (doc_id, line_no, sent_no)) from g"""))
def conllu_fields(spark, d):
    """The fields of the documents as CoNLL-U, with attributes of documents and numbered names of comments."""
    text = F.replace(F.replace("conllu", F.lit("# newdoc id = "), F.lit("# newdoc Genre[a]=")), F.lit("# newpar id = "), F.lit("# topic-3 = "))
    lines = conllu.documents(tk.with_space_after(dealt_gold(spark, d))).select(F.explode(F.split(text, "\n")).alias("line"))
    return training.field_inventory(lines)


@query(sql("g", """select doc_id, line_no, sent_no, (tok_no + 1)::varchar as id, 'upos' as problem from g where doc_id % 3 = 0 and upos = 'PROPN' union all
    select doc_id, line_no, sent_no, null, 'cycle' from g where doc_id % 3 = 1 and tok_no = 1 union all
    select doc_id, line_no, sent_no, '3', 'deprel' from g where doc_id % 3 = 2 and tok_no = 2 union all select doc_id, line_no, sent_no, null, 'roots' from g where doc_id % 3 = 2 and tok_no = 2"""))
def conllu_problems(spark, d):
    """Of the documents as CoNLL-U, by remainder: names under a tag of their own, second words that are their own heads, third words that are roots."""
    of = lambda k, text: F.when(F.col("doc_id") % 3 == k, text)
    c = F.col("conllu")
    head = lambda k, h: F.regexp_replace(c, rf"(?m)^{k}\t((?:[^\t\n]*\t){{5}})[0-9]+\t", rf"{k}\t$1{h}\t".replace("\\t", "\t"))
    files = conllu.documents(dealt_gold(spark, d).withColumn("space_after", F.lit(True))).withColumn("conllu", F.coalesce(of(0, F.replace(c, F.lit("\tPROPN\t"), F.lit("\tNAME\t"))), of(1, head(2, 2)), head(3, 0)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "sent_no")) - 1
    places = tk.sentence_bounds(dealt_gold(spark, d)).select("doc_id", "line_no", F.col("sent_no").alias("s"), nth.alias("sent_no"))
    found = beside(validation.found(files), places, ("doc_id", "sent_no")).where("s is not null")
    return found.select("doc_id", *_long("line_no"), F.col("s").cast("long").alias("sent_no"), "id", "problem")


@query(sql("g", "select distinct case when upos = 'ADV' then 'ADVX' else upos end as upos from g where upos = 'ADV'"))
def upos_extended(spark, d):
    return training.extended_upos(gold(spark, d).select(F.when(F.col("upos") == "ADV", "ADVX").otherwise(F.col("upos")).alias("upos")))


@query(sql("v", "select f.form from (select distinct reverse(form) as form from v) f where f.form not in (select form from v) and lower(f.form) not in (select form from v)"))
def oov_tokens(spark, d):
    vocab = training.vocabulary(gold(spark, d))
    return evaluation.oov(vocab.select(F.reverse("form").alias("form")).distinct(), vocab)


@query(sql("v", """, c as (select form, sum(cnt)::bigint as own from v group by 1)
    select bucket, count(*) as forms, sum(freq)::bigint as freq from (select case when f < 5 then '1-4' when f < 20 then '5-19' when f < 100 then '20-99' else '100+' end as bucket, f as freq from
    (select c.own + coalesce(l.own, 0) as f from c left join c l on l.form = lower(c.form) and lower(c.form) <> c.form)) group by 1"""))
def word_frequency_bucket(spark, d):
    vocab = training.vocabulary(gold(spark, d))
    freq = evaluation.word_frequency(vocab.select("form").distinct(), vocab)
    return freq.groupBy(t.frequency_bucket(F.col("freq")).alias("bucket")).agg(F.count("*").alias("forms"), F.sum("freq").alias("freq"))


@query()
def lemma_rules(spark, d):
    vocab = training.vocabulary(gold(spark, d))
    rules = training.ending_rules(vocab, kernels.lemma_rule(F.col("form"), F.col("lemma")), length=4)
    return training.best_rule(rules)


# --- candidates, Viterbi --------------------------------------------------------------------------------------

_KNOWN = "k as (select form, upos as tag, sum(cnt) as cnt from v group by 1, 2)"
_FORMS = "f as (select distinct form from v union select distinct translate(form, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') from v union select distinct 'zz' || form from v)"
_LEX = "lx as (select f.form, tag, cnt::double as weight, 'exact' as source from f join k using (form) union all select f.form, k.tag, k.cnt * 0.1, 'lower' from f join k on k.form = lower(f.form) where lower(f.form) <> f.form and f.form not in (select form from k))"


def _forms(vocab: DataFrame) -> DataFrame:
    form = vocab.select("form")
    return form.unionByName(form.select(F.translate("form", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("form"))).unionByName(form.select(F.concat(F.lit("zz"), "form").alias("form"))).distinct()


@query(sql("v", f", {_KNOWN}, {_FORMS}, {_LEX} select form, tag, round(weight, 4) as weight, source from lx"))
def lexicon_candidates(spark, d):
    vocab = _parked_vocab(spark, d)
    return tagging.lexicon_candidates(_forms(vocab), vocab).withColumn("weight", F.round("weight", 4))


_EN = "en as (select ending, tag, count(*) as types from (select tag, substr(form, length(form) - n + 1) as ending from (select distinct form, lemma, upos as tag from v), range(1, 7) r(n) where n <= length(form)) group by 1, 2)"
_END = "ec as (select form, ending, tag, types * pow(5.0, -nth) as weight, 'ending' as source from (select q.form, ending, en.tag, en.types, dense_rank() over (partition by q.form order by length(ending) desc) as nth from (select form, substr(form, length(form) - n + 1) as ending from fo, range(1, 7) r(n) where n <= length(form)) q join en using (ending)) where nth <= 3)"


@query(sql("v", f", fo as (select distinct 'zz' || form as form from v), {_EN}, {_END} select form, ending, tag, round(weight, 4) as weight, source from ec"))
def ending_candidates(spark, d):
    vocab = _parked_vocab(spark, d)
    forms = vocab.select(F.concat(F.lit("zz"), "form").alias("form")).distinct()
    return tagging.ending_candidates(forms, training.endings(vocab)).withColumn("weight", F.round("weight", 4))


def _parked_vocab(spark, d) -> DataFrame:
    """The vocabulary, written once for the many places that read it."""
    return park(training.vocabulary(gold(spark, d)), "vocabulary")


def _lattice(spark, d, given):
    vocab = _parked_vocab(spark, d)
    forms = _forms(vocab).withColumn("given", F.expr(given) if isinstance(given, str) else given)
    found = tagging.lattice(forms, vocab, training.endings(vocab), training.tag_types(vocab))
    # tenths of counts and of counts over 125 are whole numbers in units of 1/1,250: nothing is left to round
    whole = lambda c: F.round(F.col(c) * 1_250).cast("long").alias(c)
    return found.select("form", "tag", "lemma", "xpos", "feats", "ending", whole("weight"), whole("total"), "source", "given")


#: The cascade: entries, entries of the lower-case form, endings, the given tag, types; g(f) is whether a tag agrees.
_CASCADE = f"""
    , {_FORMS}, fg as (select form, $given as given from f),
    c1 as (select fg.form, given, v.upos as tag, lemma, xpos, feats, null as ending, cnt::double as weight, 'exact' as source from fg join v using (form) where given = '_' or given = v.upos),
    r1 as (select * from fg anti join c1 using (form, given)),
    c2 as (select r1.form, given, v.upos, lemma, xpos, feats, null, cnt * 0.1, 'lower' from r1 join v on v.form = lower(r1.form) where lower(r1.form) <> r1.form and (given = '_' or given = v.upos)),
    r2 as (select * from r1 anti join c2 using (form, given)), fo as (select distinct form from r2), {_EN}, {_END},
    c3 as (select r2.form, given, tag, null, null, null, ending, weight, source from r2 join ec using (form) where given = '_' or given = tag),
    r3 as (select * from r2 anti join c3 using (form, given)), c4 as (select form, given, given, null, null, null, null, 1.0, 'existing' from r3 where given <> '_'),
    r4 as (select * from r3 where given = '_'), ty as (select upos as tag, count(distinct form)::double as types from v group by 1),
    c5 as (select form, given, tag, null, null, null, null, types, 'prior' from r4, ty),
    al as (select * from c1 union all select * from c2 union all select * from c3 union all select * from c4 union all select * from c5)
    select form, given, tag, lemma, xpos, feats, ending, round(weight * 1250)::bigint as weight, (sum(round(weight * 1250)::bigint) over (partition by form, given))::bigint as total, source from al"""
_GIVEN = "case length(form) % 4 when 0 then 'VERB' when 1 then 'X' else '_' end"


@query(sql("v", _CASCADE.replace("$given", "'_'")))
def lattice_normalized(spark, d):
    return _lattice(spark, d, "'_'")


@query(sql("v", _CASCADE.replace("$given", _GIVEN)))
def lattice_constrained(spark, d):
    return _lattice(spark, d, _GIVEN)


_KEYED = "case length(form) % 4 when 0 then 'VERB' when 2 then '_' || chr(9) || '_' || chr(9) || 'NO-s' || chr(9) || '_' when 3 then '_' || chr(9) || '_' || chr(9) || '_' || chr(9) || 'Number=Plur' else '_' end"
_TAG_OF = "split_part(given, chr(9), 1)"
_BOUND = "(length(form) % 4 <> 2 or v.xpos = 'NO-s') and (length(form) % 4 <> 3 or list_contains(string_split(v.feats, '|'), 'Number=Plur'))"
_BY_ATTRIBUTES = _CASCADE.replace("$given", _KEYED).replace("where given = '_' or given = v.upos)", f"where ({_TAG_OF} = '_' or {_TAG_OF} = v.upos) and {_BOUND})").replace("and (given = '_' or given = v.upos))", f"and ({_TAG_OF} = '_' or {_TAG_OF} = v.upos) and {_BOUND.replace('length(form)', 'length(r1.form)')})")
_BY_ATTRIBUTES = _BY_ATTRIBUTES.replace("where given = '_' or given = tag)", f"where {_TAG_OF} = '_' or {_TAG_OF} = tag)").replace("select form, given, given, null, null, null, null, 1.0, 'existing' from r3 where given <> '_'", f"select form, given, {_TAG_OF}, null, null, null, null, 1.0, 'existing' from r3 where {_TAG_OF} <> '_'").replace("from r3 where given = '_')", f"from r3 where {_TAG_OF} = '_')")


@query(sql("v", _BY_ATTRIBUTES))
def lattice_attributes(spark, d):
    """Candidates bound by a given tag, xpos or features."""
    none = F.lit("_")
    when = lambda k, x: F.when(F.length("form") % 4 == k, x).otherwise("_")
    key = tagging.given_key(when(0, "VERB"), none, when(2, "NO-s"), when(3, "Number=Plur"))
    return _lattice(spark, d, key)


@query(sql("v", f"""
    , en as (select substr(form, length(form) - n + 1) as ending, tag, count(*) as cnt from (select distinct form, lemma, upos as tag from v where lower(form) = form and (lemma = form or lemma || 's' = form)), range(1, 7) r(n) where n <= length(form) group by 1, 2)
    select ending, tag, cnt from en"""))
def lemma_rule_counts(spark, d):
    """Of all lemma rules those of regular forms, over endings."""
    vocab = _parked_vocab(spark, d).where("lower(form) = form and (lemma = form or concat(lemma, 's') = form)")
    rules = training.ending_rules(vocab, kernels.lemma_rule(F.col("form"), F.col("lemma")))
    return rules.groupBy("ending", "tag").agg(F.sum("cnt").alias("cnt"))


def _model(spark, d):
    g = dealt_gold(spark, d)
    return model.from_counts(_parked_vocab(spark, d), training.transitions(g), training.case_profile(g))


_AT = "doc_id, line_no, sent_no"


#: A step of the search: of each tag of the next word the best way there. A path is the string of its tags. Without a way that counts,
#: a tag starts afresh behind the best tag before.
_STEP = """list_transform(x.c, lambda c: list_sort(list_transform(s.r, lambda q: {'v': -(q.s * ((coalesce(c.n[q.i], 0) + $smooth) * (greatest(c.p, 1e-10) * c.k))), 'i': q.i, 'b': -q.s, 'path': q.path, 'to': c.i, 'p': c.p, 'name': c.t})))"""
_NEXT = f"""list_transform({_STEP}, lambda w: case when w[1].v < 0 then {{'i': w[1].to, 's': -w[1].v, 'path': w[1].path || ' ' || w[1].name}}
        else {{'i': w[1].to, 's': w[1].p, 'path': list_sort(list_transform(w, lambda z: {{'b': z.b, 'i': z.i, 'path': z.path}}))[1].path || ' ' || w[1].name}} end)"""
_SCALED = "list_transform({0}, lambda q: {{'i': q.i, 's': q.s / list_max(list_transform({0}, lambda z: z.s)), 'path': q.path}})"
#: vi: the tags of all tokens.
_VITERBI = f"""
    , c as (select form, upos as tag, max(cnt) / any_value(al) as p from (select *, sum(cnt) over (partition by form) as al from v) group by 1, 2),
    tg as (select tag, row_number() over (order by tag) as i from (select distinct tag from c)),
    tr as (select prev, tag, count(*)::double as n from (select lag(upos) over (partition by {_AT} order by tok_no) as prev, upos as tag from g) where prev is not null group by 1, 2),
    tn as (select t.tag, t.i, list(coalesce(n, 0.0) order by b.i) as n from tg t cross join tg b left join tr on tr.prev = b.tag and tr.tag = t.tag group by 1, 2),
    cs as (select tag, wcase, greatest(n / sum(n) over (partition by tag), 0.001) as k from (select upos as tag, {_CASE} as wcase, count(*) as n from g group by 1, 2)),
    fc as (select form, list({{'i': i, 't': c.tag, 'p': p, 'k': coalesce(k, 1.0), 'n': tn.n}} order by i) as c from (select *, {_CASE} as wcase from c) c join tn using (tag) left join cs using (tag, wcase) group by 1),
    se as (select {_AT}, list({{'c': c, 'r': case when tok_no = 0 then list_transform(c, lambda z: {{'i': z.i, 's': z.p / list_max(list_transform(c, lambda y: y.p)), 'path': z.t}}) end}} order by tok_no) as ws from g join fc using (form) group by 1, 2, 3),
    fi as (select {_AT}, list_reduce(ws, lambda s, x: {{'c': x.c, 'r': {_SCALED.format(_NEXT)}}}).r as r from se),
    pa as (select {_AT}, string_split(list_sort(list_transform(r, lambda q: {{'s': -q.s, 'i': q.i, 'path': q.path}}))[1].path, ' ') as path from fi),
    vi as (select g.doc_id, g.line_no, g.sent_no, g.tok_no, form, upos, path[g.tok_no + 1] as tag from g join pa using ({_AT}))"""


@query(sql("v", _VITERBI.replace("$smooth", "0") + " select * exclude (upos) from vi"))
def viterbi_tags(spark, d):
    m = _model(spark, d)
    g = dealt_gold(spark, d)
    lattice = park(tagging.lattice(g.select("form").distinct(), m.vocab, m.endings, m.types), "lattice")
    return tagging.viterbi(g.select(*PLACE, "form"), lattice, m.transitions, cases=m.cases).select("doc_id", *_long("line_no", "sent_no", "tok_no"), "form", "tag")


def _scored(smooth: str) -> str:
    return "select * from (" + sql("v", _VITERBI.replace("$smooth", smooth) + f" select {smooth}::double as smooth, count(*) filter (tag = upos) as correct, count(*) as total from vi") + ")"


@query(f"{_scored('0.0')} union all {_scored('0.5')}")
def tuning_scores(spark, d):
    """Two settings decoded in one pass over shared candidates."""
    m = _model(spark, d)
    bench = tuning.Bench(m, park(gold(spark, d), "gold"))
    tried = [m.settings | {"transitionsmooth": x} for x in (0.0, 0.5)]
    return spark.createDataFrame([(x["transitionsmooth"], s.right, s.total) for x, s in zip(tried, bench.scores(tried), strict=True)], "smooth double, correct long, total long")


@query(sql("v", """
    , k as (select form, upos as tag, sum(cnt) as cnt from v group by 1, 2),
    f as (select form, arg_max(tag, cnt - rank / 1000.0) as tag, max(cnt)::double / sum(cnt)::double as confidence from (select *, row_number() over (partition by form order by tag) as rank from k) group by 1),
    b as (select g.lang, doc_id, line_no, sent_no, upos = f.tag as fits, least(floor(confidence * 20)::int, 19) as bin from g join f using (form)),
    c as (select bin, max(p) over (order by bin) as calibrated from (select bin, count(*) filter (fits)::double / count(*)::double as p from b group by 1)),
    w as (select lang, doc_id, line_no, sent_no, min(calibrated) < 0.95 as unsure, count(*) as n from b join c using (bin) group by 1, 2, 3, 4)
    select lang, count(*) as sentences, count(*) filter (unsure) as routed, coalesce(sum(n) filter (unsure), 0)::bigint as routed_tokens from w group by 1"""))
def routed_share(spark, d):
    """How much of each language a second stage would read, by calibrated confidence of the most frequent tag."""
    g, vocab = gold(spark, d), _parked_vocab(spark, d)
    share = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("form"))
    k = vocab.groupBy("form", F.col("upos").alias("tag")).agg(F.sum("cnt").alias("cnt")).withColumn("confidence", share)
    best = k.withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy(F.desc("cnt"), "tag"))).where("rank = 1").drop("rank", "cnt")
    tokens = g.select("lang", *tk.SENTENCE, "form", "upos", F.xxhash64(*PLACE).alias("place"))
    tagged = park(salted_join(tokens, best, "form", "place").select("lang", *tk.SENTENCE, "upos", "tag", "confidence"), "first-stage")
    table = stages.calibration(tagged, F.col("tag") == F.col("upos"))
    rows = stages.routed(stages.calibrated(tagged, table), 0.95)
    s = rows.groupBy("lang", *tk.SENTENCE).agg(F.bool_or("unsure").alias("unsure"), F.count("*").alias("n"))
    return s.groupBy("lang").agg(F.count("*").alias("sentences"), F.count(F.when(F.col("unsure"), 1)).alias("routed"), F.coalesce(F.sum(F.when(F.col("unsure"), F.col("n"))), F.lit(0)).alias("routed_tokens"))


@query(sql("g", "select case when length(form) % 3 = 0 then upos else 'free' end as given, count(*) as tokens, sum(case when length(form) % 3 = 0 then 1 else 0 end)::bigint as kept, 0::bigint as empty from g group by 1"))
def tag_end_to_end(spark, d):
    """Every token comes out, given tags stay, none is empty."""
    m, g = _model(spark, d), dealt_gold(spark, d)
    given = F.when(F.length("form") % 3 == 0, F.col("upos")).otherwise("_")
    out = model.tagged(m, g.select(*PLACE, "form", given.alias("upos")))
    kind = F.when(F.length("form") % 3 == 0, F.col("upos")).otherwise("free")
    return out.groupBy(kind.alias("given")).agg(F.count("*").alias("tokens"), F.count(F.when(F.length("form") % 3 == 0, 1)).alias("kept"), F.count(F.when(F.col("upos").isin("_", "") | F.col("lemma").isin("_", ""), 1)).alias("empty"))


# --- evaluation -----------------------------------------------------------------------------------------------


def _aligned(spark, d):
    g = dealt_gold(spark, d)
    return evaluation.same_place(g, predicted(g).withColumn("number", F.col("tok_no")), ("form", "upos", "xpos", "feats", "lemma", "head", "deprel", "number")).withColumnRenamed("pred_number", "pred_tok_no")


_METRICS = ["tokenization", "upos", "xpos", "feats", "lemma", "feats_partial", "upos_feats"]


@query(sql("pr", """, o as (select count(*) as total, count(*) filter (p_form = form) as tokenization, count(*) filter (p_upos = upos) as upos, count(*) filter (p_xpos = xpos) as xpos, count(*) filter (p_feats = feats) as feats, count(*) filter (p_lemma = lemma) as lemma,
    count(*) filter (len(list_filter(string_split(p_feats, '|'), lambda z: not list_contains(string_split(feats, '|'), z))) = 0) as feats_partial, count(*) filter (p_upos = upos and p_feats = feats) as upos_feats from pr)
    select metric, correct, total, round(correct / total, 6) as accuracy from (unpivot o on tokenization, upos, xpos, feats, lemma, feats_partial, upos_feats into name metric value correct)"""))
def eval_metrics(spark, d):
    return evaluation.metrics(_aligned(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


#: Gold and predicted tokens with regularised forms and expansions, some without a partner, some in two parts.
_PARTS = """, x as (select form, p_form, length(form) % 7 <> 3 as met, length(form) % 10 = 0 as two, length(form) % 20 = 0 as p_two,
        {'upos': upos, 'xpos': xpos, 'feats': case when length(form) % 9 = 2 then '_' else feats end, 'lemma': lemma, 'reg': case when length(form) % 4 = 0 then lower(form) else '_' end, 'expan': case when length(form) % 6 = 0 then form || '.' else '' end} as g,
        {'upos': p_upos, 'xpos': p_xpos, 'feats': case when length(form) % 5 = 2 then split_part(p_feats, '|', 1) when length(form) % 5 = 1 then '' else p_feats end, 'lemma': p_lemma, 'reg': case when length(form) % 8 = 0 then lower(form) else '_' end, 'expan': case when length(form) % 12 = 0 then form || '.' else '_' end} as p from pr),
    y as (select *, case when two then [{'upos': 'ADP', 'xpos': '_', 'feats': '', 'lemma': 'a', 'reg': '_', 'expan': '_'}, g] else [g] end as gs, case when p_two then [{'upos': 'DET', 'xpos': 'x', 'feats': '_', 'lemma': 'a', 'reg': '_', 'expan': '_'}, p] else [p] end as ps from x),
    w as (select met, met and len(gs) = len(ps) as same, unnest(range(1, len(gs) + 1)) as k, gs, ps from y),
    z as (select met, same, lambda_value(gs[k]) as g, case when same then lambda_value(ps[k]) end as p from w)"""
_FIELDS = ("upos", "xpos", "feats", "lemma", "reg", "expan")
_CLEAN = lambda x: "{" + ", ".join(f"'{c}': case when {x}.{c} = '_' then '' else coalesce({x}.{c}, '') end" for c in _FIELDS) + "}"
_PARTS = _PARTS.replace("lambda_value(gs[k])", _CLEAN("gs[k]")).replace("lambda_value(ps[k])", _CLEAN("ps[k]"))
_WITHIN = "(case when g.feats = '' then p.feats = '' else p.feats <> '' and list_has_all(string_split(g.feats, '|'), string_split(p.feats, '|')) end)"
_COUNTED = [(c, f"g.{c} <> ''", f"same and g.{c} = p.{c}") for c in _FIELDS if c != "feats"] + [
    ("feats", "true", "same and g.feats = p.feats"), ("feats_partial", "(same and (g.feats <> '' or p.feats <> '')) or (not met and g.feats <> '')", f"same and {_WITHIN}"),
    ("upos_feats", "g.upos <> '' or g.feats <> ''", "same and g.upos = p.upos and g.feats = p.feats")]


@query(sql("pr", _PARTS + " select 'tokenization' as metric, count(*) filter (met and form = p_form) as correct, count(*) filter (met) as total from x" + "".join(f" union all select '{name}', count(*) filter (({counts}) and ({right})), count(*) filter ({counts}) from z" for name, counts, right in _COUNTED)))
def part_metrics(spark, d):
    g = dealt_gold(spark, d)
    rows = evaluation.same_place(g, predicted(g), ("form", "upos", "xpos", "feats", "lemma"))
    by = lambda n, k, value, other: F.when(F.length("form") % n == k, value).otherwise(other)
    low, dot = F.lower("form"), F.concat("form", F.lit("."))
    rows = rows.withColumn("feats", by(9, 2, F.lit("_"), F.col("feats"))).withColumn("reg", by(4, 0, low, F.lit("_"))).withColumn("expan", by(6, 0, dot, F.lit("")))
    rows = rows.withColumn("pred_feats", by(5, 2, F.substring_index("pred_feats", "|", 1), by(5, 1, F.lit(""), F.col("pred_feats")))).withColumn("pred_reg", by(8, 0, low, F.lit("_"))).withColumn("pred_expan", by(12, 0, dot, F.lit("_")))
    rows = rows.withColumn("aligned", F.length("form") % 7 != 3)
    own = lambda side: F.struct(*(F.col(f"{side}{c}").alias(c) for c in _FIELDS))
    first = lambda *values: F.struct(*(F.lit(v).alias(c) for v, c in zip(values, _FIELDS, strict=True)))
    none = F.lit(None)
    rows = rows.withColumn("parts", by(10, 0, F.array(first("ADP", "_", "", "a", "_", "_"), own("")), none)).withColumn("pred_parts", by(20, 0, F.array(first("DET", "x", "_", "a", "_", "_"), own("pred_")), none))
    return evaluation.part_metrics(rows).drop("accuracy")


@query(sql("pr", "select metric, correct, total, round(correct / total, 6) as accuracy from (select unnest([{'metric': 'UAS', 'correct': u, 'total': n}, {'metric': 'LAS', 'correct': l, 'total': n}], recursive := true) from (select count(*) as n, count(*) filter (p_head = head) as u, count(*) filter (p_head = head and p_deprel = deprel) as l from pr))"))
def uas_las(spark, d):
    return evaluation.attachment(_aligned(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(sql("mw", f", {_MWTS}, {_PAIRED} select count(im.form) as gold, count(cp.form) as pred, count(*) filter (im.form is not null and cp.form is not null) as found, count(*) filter (mwt_end = second) as same_parts from im full join cp on im.doc_id = cp.doc_id and im.line_no = cp.line_no and im.sent_no = cp.sent_no and mwt_start = first"))
def split_prf(spark, d):
    g = split_words(gold(spark, d))
    pairs = tk.contraction_pairs(g).select("doc_id", "line_no", "sent_no", F.col("first").alias("mwt_start"), F.col("second").alias("mwt_end"))
    return evaluation.split_scores(tk.implicit_mwts(g), pairs)


_LEN = "case when length(form) <= 2 then '1-2' when length(form) <= 4 then '3-4' when length(form) <= 7 then '5-7' when length(form) <= 10 then '8-10' else '11+' end"


@query(sql("pr", f""", e as (select upos as gold_upos, {_LEN} as length, lang, (p_upos <> upos)::bigint as w from pr)
    select case when grouping(gold_upos) = 0 then 'gold_upos' when grouping(length) = 0 then 'length' when grouping(lang) = 0 then 'lang' else 'all' end as grouping,
    case when grouping(gold_upos) = 0 then gold_upos when grouping(length) = 0 then length when grouping(lang) = 0 then lang else '' end as value, count(*) as total, sum(w)::bigint as errors from e group by grouping sets ((), (gold_upos), (length), (lang))"""))
def error_grouping_sets(spark, d):
    rows = _aligned(spark, d).withColumn("gold_upos", F.col("upos")).withColumn("length", t.length_bucket(F.length("form")))
    return evaluation.error_report(rows, F.col("pred_upos") != F.col("upos"), "gold_upos", "length", "lang")


def _sides(spark, d):
    """Gold tokens with running numbers, and a predicted side that lost every token of one character."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "sent_no", "tok_no")) - 1
    g = dealt_tok(spark, d).withColumn("n", number.cast("long"))
    g = g.withColumn("sent_no", F.col("line_no") * 10000 + F.col("sent_no")).select("doc_id", "n", "sent_no", "form")
    return g, g.where("length(form) > 1").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1)


@query()
def align_greedy(spark, d):
    return evaluation.align(*_sides(spark, d))


#: Without one-character tokens the longest common blocks are all that is left of the gold side.
#: Every 13th token but one like its neighbours is gone, others are changed, and some follow that the other side lacks.
_EDITED = r"""ed as (select doc_id, n, key, case when n * 7919 % 13 = 0 and key <> coalesce(lag(key) over w, '') and key <> coalesce(lead(key) over w, '') then 'gone' when n * 7919 % 13 = 5 then 'changed' when n * 7919 % 13 = 9 then 'more' else 'kept' end as how
    from (select doc_id, row_number() over (partition by doc_id order by line_no, sent_no, tok_no) - 1 as n, case when regexp_replace(lower(form), '[^\p{L}\p{N}]', '', 'g') <> '' then regexp_replace(lower(form), '[^\p{L}\p{N}]', '', 'g') else lower(form) end as key from g) window w as (partition by doc_id order by n))"""


def _edited(spark, d) -> tuple[DataFrame, DataFrame]:
    own = Window.partitionBy("doc_id").orderBy("line_no", "sent_no", "tok_no")
    w = Window.partitionBy("doc_id").orderBy("n")
    g = dealt_gold(spark, d).select("doc_id", (F.row_number().over(own) - 1).alias("n"), "form").withColumn("key", t.align_key(F.col("form")))
    odd = lambda k: F.col("n") * 7919 % 13 == k
    alone = (F.col("key") != F.coalesce(F.lag("key").over(w), F.lit(""))) & (F.col("key") != F.coalesce(F.lead("key").over(w), F.lit("")))
    forms = F.when(odd(0) & alone, F.array().cast("array<string>")).when(odd(5), F.array(F.concat(F.lit("zz§"), F.col("n").cast("string")))).when(odd(9), F.array("form", F.concat(F.lit("qq§"), F.col("n").cast("string")))).otherwise(F.array("form"))
    p = g.withColumn("forms", forms).select("doc_id", "n", F.posexplode("forms").alias("k", "form"))
    return g.select("doc_id", "n", "form"), p.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "k")) - 1).alias("n"), "form")


@query(sql("g", f", {_EDITED} select doc_id, count(*) filter (how in ('kept', 'more')) as aligned, count(*) filter (how in ('kept', 'more')) as equal, true as forward from ed group by 1 having count(*) filter (how in ('kept', 'more')) > 0"))
def align_blocks(spark, d):
    """Pairs of edited documents: all that is left of the tokens, each with one of its own key, in the order of both sides."""
    g, p = (park(x, "sides") for x in _edited(spark, d))
    found = park(blocks.align_blocks(g, p), "pairs")
    keyed = lambda rows, n: rows.select("doc_id", F.col("n").alias(n), t.align_key(F.col("form")).alias(f"{n}_key"))
    met = found.join(keyed(g, "g"), ["doc_id", "g"]).join(keyed(p, "p"), ["doc_id", "p"])
    met = met.withColumn("back", F.col("p") <= F.lag("p").over(Window.partitionBy("doc_id").orderBy("g")))
    return met.groupBy("doc_id").agg(F.count("*").alias("aligned"), F.count(F.when(F.col("g_key") == F.col("p_key"), 1)).alias("equal"), F.coalesce(~F.bool_or("back"), F.lit(True)).alias("forward"))


_RUNS = "er as (select doc_id, line_no, sent_no, min(n) as start, max(n) + 1 as e, count(*) as k from (select *, n - row_number() over (partition by doc_id, line_no, sent_no order by n) as grp from (select g.*, b.tok_start + tok_no as n from g join b using (doc_id, line_no, sent_no)) where upos = 'PROPN') group by doc_id, line_no, sent_no, grp)"
_BOUNDS = "b as (select doc_id, line_no, sent_no, e - n as tok_start, e as tok_end from (select *, (sum(n) over (partition by doc_id order by line_no, sent_no))::bigint as e from (select doc_id, line_no, sent_no, count(*) as n from t group by 1, 2, 3)))"


def _entities(spark, d):
    """Runs of proper nouns as spans of document token numbers."""
    g = gold(spark, d)
    bounds = tk.sentence_bounds(g)
    n = g.where("upos = 'PROPN'").join(bounds, ["doc_id", "line_no", "sent_no"]).withColumn("n", F.col("tok_start") + F.col("tok_no"))
    n = n.withColumn("grp", F.col("n") - F.row_number().over(Window.partitionBy("doc_id", "line_no", "sent_no").orderBy("n")))
    spans = n.groupBy("doc_id", "line_no", "sent_no", "grp").agg(F.min("n").alias("start"), (F.max("n") + 1).alias("end")).select("doc_id", "start", "end", F.when(F.col("end") - F.col("start") > 1, "ORG").otherwise("PER").alias("label"))
    return spans, bounds


_ENTITIES = f", {_BOUNDS}, {_RUNS}, ei as (select doc_id, line_no, sent_no, (start - tok_start + 1)::bigint as first, (er.e - tok_start)::bigint as last, case when k > 1 then 'ORG' else 'PER' end as label from er join b using (doc_id, line_no, sent_no))"


@query(sql("g", _ENTITIES + " select * from ei"))
def entity_to_sentence(spark, d):
    return evaluation.entities_in_sentences(*_entities(spark, d)).select("doc_id", *_long("line_no", "sent_no"), *_long("first", "last"), "label")


@query(sql("g", _ENTITIES + " select *, label || '_' || row_number() over (partition by doc_id, line_no, sent_no, label order by first, last) as ne from ei"))
def ne_sequence_ids(spark, d):
    return evaluation.numbered_entities(evaluation.entities_in_sentences(*_entities(spark, d))).select("doc_id", *_long("line_no", "sent_no"), *_long("first", "last"), "label", "ne")


@query(sql("g", _ENTITIES + " select * from ei where label = 'PER' union all select * from ei where label <> 'PER'"))
def ner_merge(spark, d):
    found = evaluation.entities_in_sentences(*_entities(spark, d)).select("doc_id", *_long("line_no", "sent_no"), *_long("first", "last"), "label")
    return evaluation.merged_entities(found.where("label = 'PER'"), found, ("doc_id", "line_no", "sent_no", "first", "last", "label"))


@query(sql("pr", "select case when (length(form) % 10) / 10.0 < 0.75 then p_upos else upos end as upos, (length(form) % 10) / 10.0 < 0.75 as from_fallback, count(*) as n from pr group by 1, 2"))
def confidence_merge(spark, d):
    g = gold(spark, d).withColumn("confidence", F.length("form") % 10 / 10)
    return evaluation.merged_by_confidence(g, predicted(g), ("upos",), PLACE).groupBy("upos", "from_fallback").agg(F.count("*").alias("n"))


@query(sql("g", """, up(doc_id, line_no, sent_no, tok_no, above, head) as (select doc_id, line_no, sent_no, tok_no, tok_no, head from g union all select u.doc_id, u.line_no, u.sent_no, u.tok_no, g.tok_no, g.head from up u join g on g.doc_id = u.doc_id and g.line_no = u.line_no and g.sent_no = u.sent_no and g.tok_no = u.head - 1)
    select doc_id, line_no, sent_no, above as tok_no, min(tok_no) as first, max(tok_no) as last, count(*) as size from up group by 1, 2, 3, 4""").replace("with l as", "with recursive l as", 1))
def covering_spans(spark, d):
    return evaluation.covering_spans(dealt_gold(spark, d)).select("doc_id", *_long("line_no", "sent_no", "tok_no", "first", "last", "size"))


@query(sql("g", "select depth, count(*) as n from (select length(bin(tok_no + 1)) - 1 as depth from g) group by 1"))
def tree_depth(spark, d):
    return evaluation.depths(dealt_gold(spark, d)).groupBy("depth").agg(F.count("*").alias("n"))


# --- language -------------------------------------------------------------------------------------------------

_TRI = "tr as (select doc_id, lang, substr(x, i, 3) as trigram, count(*) as n from (select doc_id, lang, substr(lower(text), 1, 20000) as x from documents), unnest(range(1, length(x) - 1)) r(i) where length(x) >= 3 group by 1, 2, 3), pf as (select lang, trigram, row_number() over (partition by lang order by sum(n) desc, trigram) as rank from tr group by 1, 2 qualify rank <= 300)"
_SCORES = "sc as (select doc_id, y.lang, greatest(0, 1 - sum(coalesce(abs(n - rank)::double, 300.0)) / (300.0 * count(*))) as score from tr cross join (select distinct lang from pf) y left join pf on pf.trigram = tr.trigram and pf.lang = y.lang group by 1, 2)"


@query(f"with {_TRI} select lang, trigram, rank from pf")
def trigram_profile(spark, d):
    return language.profiles(docs(spark, d), most_chars=language.MOST_CHARS).select("lang", "trigram", F.col("rank").cast("long").alias("rank"))


@query(f"with {_TRI}, {_SCORES} select doc_id, lang, round(score, 6) as score from sc")
def trigram_detect(spark, d):
    return language.scores(docs(spark, d), language.profiles(docs(spark, d), most_chars=language.MOST_CHARS)).withColumn("score", F.round("score", 6))


@query()
def detect_confusion(spark, d):
    found = language.detected(language.scores(docs(spark, d), language.profiles(docs(spark, d)))).withColumnRenamed("lang", "detected")
    return docs(spark, d).select("doc_id", "lang").join(found, "doc_id", "left").groupBy("lang", "detected", "reliable").agg(F.count("*").alias("n"))


# --- reports --------------------------------------------------------------------------------------------------

_RESULTS = """r as (select lang as language, source as treebank, 'b' || (length(source) % 2) as backend, 'm' || (doc_id % 3) || case when doc_id % 3 = 1 then '_full' else '' end as model, 'auto' as mode,
    case when sum(n_chars) % 5 = 0 then null else (sum(n_chars) % 1000)::double / 1000 end as uas, sum(n_chars)::bigint as size, max(doc_id) as timestamp from documents group by 1, 2, 3, 4)"""


def _results(spark, d):
    rows = docs(spark, d).select(F.col("lang").alias("language"), F.col("source").alias("treebank"), F.concat(F.lit("b"), F.length("source") % 2).alias("backend"), F.concat(F.lit("m"), F.col("doc_id") % 3, F.when(F.col("doc_id") % 3 == 1, "_full").otherwise("")).alias("model"), F.lit("auto").alias("mode"), "n_chars", "doc_id")
    out = rows.groupBy("language", "treebank", "backend", "model", "mode").agg(F.sum("n_chars").alias("size"), F.max("doc_id").alias("timestamp"))
    return out.withColumn("uas", F.when(F.col("size") % 5 != 0, (F.col("size") % 1000) / 1000))


@query(f"with {_RESULTS} select language, backend, model, mode, round(avg(uas), 6) as uas, round(avg(size), 2) as size, count(*) as treebanks from r group by 1, 2, 3, 4")
def bench_average(spark, d):
    return reports.averages(_results(spark, d), ("uas", "size")).withColumn("uas", F.round("uas", 6)).withColumn("size", F.round("size", 2))


@query(f"with {_RESULTS}, n as (select * replace (size + 1 as size, timestamp + (size % 3) - 1 as timestamp) from r) select language, treebank, backend, model, mode, size, timestamp from (select *, 0 as new from r union all select *, 1 from n) qualify row_number() over (partition by language, backend, model, treebank, mode order by timestamp desc, new desc) = 1")
def bench_upsert(spark, d):
    stored = _results(spark, d)
    new = stored.withColumn("timestamp", F.col("timestamp") + F.col("size") % 3 - 1).withColumn("size", F.col("size") + 1)
    return reports.upserted(stored, new).select("language", "treebank", "backend", "model", "mode", "size", "timestamp")


@query(f"with {_RESULTS} select language, treebank, backend, model, uas, row_number() over (partition by language order by uas desc nulls last, language, backend, model, treebank, mode) as place from r")
def bench_sorted(spark, d):
    return reports.ranked(_results(spark, d), "uas").select("language", "treebank", "backend", "model", "uas", F.col("place").cast("long").alias("place"))


@query(f"with {_RESULTS}, tb as (select distinct language, treebank from r where language <> 'es'), md as (select distinct language, backend, model from r where language <> 'de') select language, coalesce(a, 0) as treebanks, coalesce(b, 0) as models from (select language, count(*) as a from tb group by 1) full join (select language, count(*) as b from md group by 1) using (language)")
def language_coverage(spark, d):
    r = _results(spark, d)
    return reports.language_coverage(r.where("language <> 'es'").select("language", "treebank").distinct(), r.where("language <> 'de'").select("language", "backend", "model").distinct())


@query(f"with {_RESULTS} select m.language, m.backend, m.model, t.treebank from (select distinct language, backend, model from r where not (backend = 'b0' and model = 'm2')) m join (select distinct language, treebank from r) t using (language)")
def job_grid(spark, d):
    r = _results(spark, d)
    disabled = spark.createDataFrame([("b0", "m2")], "backend string, model string")
    return reports.job_grid(r.select("language", "backend", "model").distinct(), r.select("language", "treebank").distinct(), disabled)


@query(f"with {_RESULTS}, c as (select language, backend, model, max(size) % 2 = 0 as installed from r group by 1, 2, 3) select * from c qualify row_number() over (partition by language, backend order by installed desc, ends_with(model, '_full') desc, model) = 1")
def preferred_model(spark, d):
    catalog = _results(spark, d).groupBy("language", "backend", "model").agg((F.max("size") % 2 == 0).alias("installed"))
    return reports.preferred_models(catalog)


@query(f"with {_RESULTS}, c as (select language, backend, model, max(size) % 2 = 0 as installed from r group by 1, 2, 3), p as (select * from c qualify row_number() over (partition by language, backend order by installed desc, ends_with(model, '_full') desc, model) = 1) select * from p qualify row_number() over (partition by language order by installed desc, backend desc, model) = 1")
def preferred_per_language(spark, d):
    catalog = _results(spark, d).groupBy("language", "backend", "model").agg((F.max("size") % 2 == 0).alias("installed"))
    return reports.preferred_per_language(catalog, ("b1", "b0"))


@query(f"with {_RESULTS}, lo as (select backend, model, max(size) as size from r where language = 'en' group by 1, 2), re as (select backend, model || '' as model, min(size) as size from r where language = 'de' group by 1, 2) select backend, model, coalesce(lo.size, re.size) as size, lo.size is not null as installed, re.size is not null as remote from lo full join re using (backend, model)")
def registry_merge(spark, d):
    r = _results(spark, d)
    local = r.where("language = 'en'").groupBy("backend", "model").agg(F.max("size").alias("size"))
    remote = r.where("language = 'de'").groupBy("backend", "model").agg(F.min("size").alias("size"))
    return reports.merged_registry(remote, local, ("size",))


@query("select doc_id, case when p < 0.8 then 'train' when p < 0.9 then 'dev' else 'test' end as split from (select doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::bigint / 4294967296.0 as p from documents)")
def split_assign(spark, d):
    return reports.split_assigned(docs(spark, d).select("doc_id"), "doc_id")


# --- spelling -------------------------------------------------------------------------------------------------

_PAIRS = "pa as (select form, case when length(form) % 3 = 0 then '_' else replace(replace(form, 'é', 'e'), 'th', 'd') end as reg from t)"


def _pairs(spark, d):
    reg = F.when(F.length("form") % 3 == 0, "_").otherwise(F.replace(F.replace("form", F.lit("é"), F.lit("e")), F.lit("th"), F.lit("d")))
    return tok(spark, d).select("form", reg.alias("reg"))


@query(sql("t", f", {_PAIRS}, c as (select form, case when reg not in ('_', '') and reg <> form then reg end as reg, count(*) as cnt from pa group by 1, 2), w as (select *, sum(cnt) over (partition by form) as al, coalesce(sum(cnt) filter (reg is null) over (partition by form), 0) as same from c) select form, reg, cnt from (select * from w where reg is not null qualify row_number() over (partition by form order by cnt desc, reg) = 1) where cnt > same or same * 5 < al"))
def reg_dominant(spark, d):
    return training.dominant_reg(_pairs(spark, d))


_LEXPAIRS = "lp as (select distinct form, reg from pa where reg <> '_' and reg <> form)"


@query(sql("t", f", {_PAIRS}, {_LEXPAIRS} select form[-n:] as suffix, count(*) as cnt from lp, range(1, 5) r(n) where length(form) > n and length(reg) > n and form[-n:] = reg[-n:] group by 1 having count(*) >= 5"))
def suffix_patterns(spark, d):
    return training.suffix_patterns(_pairs(spark, d).where("reg <> '_' and reg <> form").distinct())


@query(sql("t", f", {_PAIRS}, {_LEXPAIRS} select form[i] as old, reg[i] as new, count(*) as cnt from lp, unnest(range(1, length(form) + 1)) r(i) where length(form) = length(reg) and form[i] <> reg[i] group by 1, 2 having count(*) >= 10"))
def substitution_patterns(spark, d):
    return training.substitutions(_pairs(spark, d).where("reg <> '_' and reg <> form").distinct())


@query(sql("t", f""", {_PAIRS}, c as (select form, case when reg not in ('_', '') and reg <> form then reg end as reg, count(*) as cnt from pa group by 1, 2),
    w as (select *, sum(cnt) over (partition by form) as al, coalesce(sum(cnt) filter (reg is null) over (partition by form), 0) as same from c),
    re as (select form, reg from (select form, reg, cnt, same, al from w where reg is not null qualify row_number() over (partition by form order by cnt desc, reg) = 1) where cnt > same or same * 5 < al),
    us as (select form, reg from re where lower(form) <> lower(reg)), vo as (select form, count(*) as f from t group by 1), lo as (select lower(form) as form, max(f) as f from vo group by 1),
    x as (select vo.form, coalesce(us.reg, ul.reg) as reg, vo.f, lower(vo.form) in (select lower(reg) from re) as regular from vo left join us on us.form = vo.form left join us ul on ul.form = lower(vo.form) and lower(vo.form) <> vo.form),
    y as (select x.*, coalesce(rv.f, rl.f) as rf, lower(x.reg) in (select lower(reg) from re) as listed, coalesce(ua.reg, ub.reg) as again from x left join vo rv on rv.form = x.reg left join lo rl on rl.form = lower(x.reg)
        left join us ua on ua.form = x.reg left join us ub on ub.form = lower(x.reg) and lower(x.reg) <> x.reg)
    select form, case when how = 'explicit' then coalesce(again, reg) else form end as reg, how from (select *, case when not regular and reg is not null and lower(reg) <> lower(form) and (rf is not null or listed) and (f < 100 or f * 10 <= coalesce(rf, 0)) then 'explicit' else 'same' end as how from y)"""))
def normalize_explicit(spark, d):
    pairs = _pairs(spark, d)
    vocab = park(pairs.groupBy("form").agg(F.count("*").alias("cnt")), "words")
    return lexicon.regular_forms(vocab.select("form"), park(training.dominant_reg(pairs), "regs"), vocab)


@query()
def normalize_bold(spark, d):
    """With suffixes and replacements, over words of which every third is spelt in a way the lexicon lacks."""
    pairs = _pairs(spark, d)
    vocab = park(pairs.groupBy("form").agg(F.count("*").alias("cnt")), "words")
    lexical = park(pairs.where("reg <> '_' and reg <> form").distinct(), "pairs")
    words = vocab.select(F.when(F.length("form") % 3 == 0, F.replace("form", F.lit("e"), F.lit("é"))).otherwise(F.col("form")).alias("form")).distinct()
    return lexicon.regular_forms(words, park(training.dominant_reg(pairs), "regs"), vocab, training.suffix_patterns(lexical), training.substitutions(lexical)).groupBy("how").agg(F.count("*").alias("n"))


# --- formats --------------------------------------------------------------------------------------------------


@query(sql("sp", r"""select doc_id, line_no, sent_no, string_agg((tok_no + 1) || chr(9) || case when form = '_' then '\_' else form end || chr(9) || lemma || chr(9) || upos || chr(9) || xpos || chr(9) || feats || chr(9) || head || chr(9) || deprel || chr(9) || '_' || chr(9) || case when space_after = false then 'SpaceAfter=No' else '_' end, chr(10) order by tok_no) as body from sp group by 1, 2, 3"""))
def conllu_lines(spark, d):
    return conllu.sentence_bodies(tk.with_space_after(dealt_gold(spark, d))).select("doc_id", *_long("line_no", "sent_no"), "body")


@query(sql("sp", "select doc_id, form, lemma, upos, xpos, feats, head, deprel, count(*) as n from sp group by all"))
def conllu_roundtrip(spark, d):
    written = conllu.documents(tk.with_space_after(dealt_gold(spark, d)))
    return conllu.parsed(written).groupBy("doc_id", "form", "lemma", "upos", "xpos", "feats", F.col("head").cast("long").alias("head"), "deprel").agg(F.count("*").alias("n"))


@query(sql("sp", "select doc_id, form, lemma, upos, count(*) as n from sp group by all"))
def teitok_roundtrip(spark, d):
    written = teitok.documents(tk.with_space_after(dealt_gold(spark, d)))
    return teitok.parsed(written).groupBy("doc_id", "form", "lemma", "upos").agg(F.count("*").alias("n"))


@query(sql("g", "select doc_id, count(*) as tokens, count(distinct (line_no, sent_no)) as sentences from g group by 1"))
def json_payload(spark, d):
    payload = conllu.json_documents(dealt_gold(spark, d))
    tree = F.from_json("payload", "sentences array<struct<tokens: array<struct<form: string>>>>")
    read = payload.select("doc_id", tree["sentences"].alias("ss"))
    return read.select("doc_id", F.aggregate("ss", F.lit(0).cast("long"), lambda a, s: a + F.size(s["tokens"])).alias("tokens"), F.size("ss").cast("long").alias("sentences"))
