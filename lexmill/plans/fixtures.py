"""Tables derived from the documents by rule, in Spark and, as common table expressions, in DuckDB.

The annotation is invented: it exercises the operators and says nothing about tagging quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import tokens as tk

#: Function words of the invented annotation; fixed values.
DETERMINERS = ("the", "der", "die", "das", "le", "la", "el")
ADPOSITIONS = ("of", "in", "to", "von", "de", "en")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_table(docs(spark, sf_dir), "lang")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt by doc_id while they are texts: what is ordered or grouped within them afterwards moves no token.

    The number of parts is given, or Spark would put texts together until they make large parts, and of each many times its size comes out.
    """
    return docs(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def dealt_tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_table(dealt(spark, sf_dir), "lang")


def annotated(tokens: DataFrame) -> DataFrame:
    """upos, lemma, feats, xpos, head (a balanced tree: token k hangs on token (k - 1) / 2), deprel by rule."""
    low = F.lower("form")
    upos = (
        F.when(~F.col("form").rlike(r"[\p{L}\p{N}\p{M}]"), "PUNCT").when(F.col("form").rlike(r"^\p{N}+$"), "NUM").when(low.isin(*DETERMINERS), "DET").when(low.isin(*ADPOSITIONS), "ADP")
        .when(F.col("form").rlike(r"^\p{Lu}") & (F.col("tok_no") > 0), "PROPN").when(F.col("form").rlike("(ing|ed|en|er)$"), "VERB").when(F.col("form").rlike("(ly|lich)$"), "ADV").otherwise("NOUN")
    )
    plural = F.col("form").rlike("s$")
    out = tokens.withColumn("upos", upos)
    out = out.withColumn("lemma", F.regexp_replace(low, "s$", ""))
    out = out.withColumn("feats", F.concat(F.when(F.length("form") % 2 == 0, "Case=Acc").otherwise("Case=Nom"), F.when(plural, "|Number=Plur").otherwise("")))
    out = out.withColumn("xpos", F.concat(F.substring("upos", 1, 2), F.when(plural, "-P2").otherwise("-s")))
    return out.withColumn("head", F.floor((F.col("tok_no") + 1) / 2).cast("int")).withColumn("deprel", F.when(F.col("tok_no") == 0, "root").otherwise("dep"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(tok(spark, sf_dir))


def dealt_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(dealt_tok(spark, sf_dir))


def predicted(tokens: DataFrame) -> DataFrame:
    """The tokens annotated as if they were in lower case, with some forms, heads and relations wrong."""
    low = annotated(tokens.withColumn("written", F.col("form")).withColumn("form", F.lower("form")))
    form = F.when(F.length("written") % 9 == 0, F.col("form")).otherwise(F.col("written"))
    head = F.when(F.length("form") % 5 == 0, F.col("tok_no")).otherwise(F.col("head"))
    return low.select(*tk.PLACE, form.alias("form"), "upos", "xpos", "feats", "lemma", head.alias("head"), F.when(F.length("form") % 7 == 0, "x").otherwise(F.col("deprel")).alias("deprel"))


def split_words(tokens: DataFrame) -> DataFrame:
    """Longer words in two halves, in halves around a hyphen, or with an apostrophe behind, without blanks between: SENTENCE, tok_no, form, upos, space_after."""
    half = F.floor(F.length("form") / 2).cast("int")
    left, right = F.substring("form", F.lit(1), half), F.substring("form", half + 1, F.length("form"))
    parts = F.when(F.length("form") % 3 == 0, F.array(left, right)).when(F.length("form") % 3 == 1, F.array(left, F.lit("-"), right)).otherwise(F.array(F.col("form"), F.lit("'")))
    parts = F.when((F.col("upos") != "PUNCT") & (F.length("form") >= 6), parts).otherwise(F.array("form"))
    each = tk.with_space_after(tokens).withColumn("parts", parts).select(*tk.SENTENCE, "tok_no", "upos", "space_after", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "form"))
    return each.select(*tk.SENTENCE, (F.col("tok_no") * 3 + F.col("k")).alias("tok_no"), "form", F.when(F.col("form").isin("-", "'"), "PUNCT").otherwise(F.col("upos")).alias("upos"), F.when(F.col("k") + 1 < F.col("n"), False).otherwise(F.col("space_after")).alias("space_after"))


def _upos(form: str, later: str) -> str:
    return rf"""case when not regexp_matches({form}, '[\p{{L}}\p{{N}}\p{{M}}]') then 'PUNCT' when regexp_matches({form}, '^\p{{N}}+$') then 'NUM' when lower({form}) in ('the', 'der', 'die', 'das', 'le', 'la', 'el') then 'DET'
        when lower({form}) in ('of', 'in', 'to', 'von', 'de', 'en') then 'ADP' when regexp_matches({form}, '^\p{{Lu}}') and {later} then 'PROPN' when regexp_matches({form}, '(ing|ed|en|er)$') then 'VERB'
        when regexp_matches({form}, '(ly|lich)$') then 'ADV' else 'NOUN' end"""


def _rest(form: str) -> str:
    return f"""regexp_replace(lower({form}), 's$', '') as lemma, case when length({form}) % 2 = 0 then 'Case=Acc' else 'Case=Nom' end || case when ends_with({form}, 's') then '|Number=Plur' else '' end as feats"""


_TOKEN = r"""([\p{L}\p{N}\p{M}]+(?:[''-][\p{L}\p{N}\p{M}]+)*''?|[^\p{Z}\p{L}\p{N}\p{M}])"""

#: l lines, s sentences, t tokens, g annotated tokens, sp tokens with space_after.
CTES = {
    "l": r"l as (select * from (select doc_id, lang, generate_subscripts(x, 1) - 1 as line_no, trim(unnest(x)) as line from (select doc_id, lang, string_split(text, chr(10)) as x from documents)) where line <> '')",
    "s": r"s as (select doc_id, lang, line_no, generate_subscripts(y, 1) - 1 as sent_no, unnest(y) as sent from (select *, list_filter(string_split(regexp_replace(line, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda z: trim(z) <> '') as y from l))",
    "t": rf"t as (select doc_id, lang, line_no, sent_no, generate_subscripts(z, 1) - 1 as tok_no, unnest(z) as form from (select *, regexp_extract_all(sent, '{_TOKEN}', 1) as z from s))",
    "g": f"""g as (select *, substr(upos, 1, 2) || case when ends_with(form, 's') then '-P2' else '-s' end as xpos from (select *, (tok_no + 1) // 2 as head, case when tok_no = 0 then 'root' else 'dep' end as deprel,
        {_upos('form', 'tok_no > 0')} as upos, {_rest('form')} from t))""",
    "sp": r"sp as (select *, regexp_matches(lead(form) over (partition by doc_id, line_no, sent_no order by tok_no), '^[\p{L}\p{N}]') as space_after from g)",
    "v": "v as (select form, lemma, upos, xpos, feats, count(*) as cnt from g group by all)",
    "pr": f"""pr as (select g.*, substr(p_upos, 1, 2) || case when ends_with(low, 's') then '-P2' else '-s' end as p_xpos, p.lemma as p_lemma, p.feats as p_feats, p_upos,
        case when length(form) % 9 = 0 then low else form end as p_form, case when length(low) % 5 = 0 then tok_no else head end as p_head, case when length(low) % 7 = 0 then 'x' else deprel end as p_deprel
        from g join (select low, {_upos('low', 'false')} as p_upos, {_rest('low')} from (select distinct lower(form) as low from g)) p on p.low = lower(g.form))""",
    "mw": """mw as (select doc_id, line_no, sent_no, tok_no * 3 + k as tok_no, parts[k + 1] as form, case when parts[k + 1] in ('-', '''') then 'PUNCT' else upos end as upos, case when k + 1 < len(parts) then false else space_after end as space_after
        from (select *, length(form) // 2 as h, case when upos <> 'PUNCT' and length(form) >= 6 then case length(form) % 3 when 0 then [form[:h], form[h + 1:]] when 1 then [form[:h], '-', form[h + 1:]] else [form, ''''] end else [form] end as parts from sp), range(3) r(k) where k < len(parts))""",
}


def sql(last: str, query: str) -> str:
    """The query behind the common tables up to `last`."""
    names = list(CTES)
    base = names[: names.index(last) + 1]
    return f"with {', '.join(CTES[n] for n in base)} {query}"


_SENTENCE = "doc_id, line_no, sent_no"
