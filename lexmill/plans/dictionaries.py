"""Queries over dictionaries that are made of the documents' own words by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import spelling
from lexmill.plans.catalog import query
from lexmill.plans.fixtures import docs

_W = r"w as (select unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as form from documents)"

#: kind, flag, crosses, strip, add, flags of the new form, condition; fixed values.
_RULES = [("SFX", "S", True, "y", "ies", [], "[^aeiou]y"), ("SFX", "S", True, "", "s", [], "[^sxzhy]"), ("SFX", "S", True, "", "es", [], "[sxzh]"), ("SFX", "D", True, "", "d", ["S"], "e"), ("SFX", "L", False, "", "like", [], "[a-y]"), ("PFX", "U", True, "", "un", [], "[^u]"), ("PFX", "U", True, "u", "on", [], "u")]


def _words(spark, d) -> DataFrame:
    return docs(spark, d).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("form"))


@query(rf"""with {_W}, b as (select distinct form as stem from w where regexp_matches(form, '^[a-z]{{4,}}$')),
    s as (select stem, stem as form, '' as suffix, true as x from b
        union all select stem, case when regexp_matches(stem, '[^aeiou]y$') then regexp_replace(stem, 'y$', 'ies') when regexp_matches(stem, '[sxzh]$') then stem || 'es' else stem || 's' end, 'S', true from b where not regexp_matches(stem, '[aeiou]y$')
        union all select stem, stem || 'd', 'D', true from b where stem like '%e' union all select stem, stem || 'ds', 'DS', true from b where stem like '%e'
        union all select stem, stem || 'like', 'L', false from b where length(stem) = 5 and stem not like '%z')
    select form, stem, '' as prefix, suffix from s
    union all select case when form like 'u%' then 'on' || form[2:] else 'un' || form end, stem, 'U', suffix from s where x and length(stem) < 7""")
def affix_forms(spark, d):
    """Forms of every small-letter word of four letters or more by flags that follow from its letters."""
    words = _words(spark, d).where("form rlike '^[a-z]{4,}$'").distinct()
    stem = F.col("form")
    flags = F.array_compact(F.array(F.lit("S"), F.when(stem.endswith("e"), "D"), F.when(F.length(stem) == 5, "L"), F.when(F.length(stem) < 7, "U")))
    rules = spark.createDataFrame(_RULES, "kind string, flag string, crosses boolean, strip string, add string, more array<string>, condition string")
    return spelling.expanded(words.select(stem.alias("stem"), flags.alias("flags")), rules)


@query(rf"""with {_W}, c as (select form, count(*) as n from w group by 1), f as (select form from c where n >= 3 and regexp_matches(form, '^[a-z]+$')),
    r as (select form as word, unnest(list_distinct(case when form = upper(form) and form <> lower(form) then [form, lower(form), upper(form[1]) || lower(form[2:])] when form[1] <> lower(form[1]) then [form, lower(form[1]) || form[2:]] else [form] end)) as read from c where regexp_matches(form, '^\p{{L}}[\p{{L}}\p{{M}}]*$')),
    u as (select word, read from r anti join (select word from r join f on r.read = f.form) using (word)),
    x as (select read, i, substr(read, 1, i - 1) || substr(read, i + 1) as key from (select distinct read from u), unnest(range(1, length(read) + 1)) t(i) union all select distinct read, 0, read from u),
    y as (select form, i, substr(form, 1, i - 1) || substr(form, i + 1) as key from f, unnest(range(1, length(form) + 1)) t(i) union all select form, 0, form from f),
    p as (select distinct read, form from x join y using (key) where (x.i = y.i) or x.i = 0 or y.i = 0),
    b as (select word, form from (select word, form, row_number() over (partition by word order by lower(word[1]) <> lower(form[1]), form) as k from u join p using (read)) where k = 1),
    g as (select word as form, case when word = upper(word) and word <> lower(word) and length(word) > 1 then upper(form) when word[1] <> lower(word[1]) then upper(form[1]) || form[2:] else form end as reg from b)
    select form, reg, n from c left join g using (form)""")
def spelling_regularised(spark, d):
    """Every form with its correction by one edit, where words in small letters that occur three times are the dictionary."""
    words = _words(spark, d)
    forms = words.where("form rlike '^[a-z]+$'").groupBy("form").agg(F.count("*").alias("n")).where("n >= 3")
    return spelling.normalized(words, forms, 1).groupBy("form", "reg").agg(F.count("*").alias("n"))
