"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.llm import chat, common, decontaminate, infill, line_dedup, mixing, near_dedup, negatives, pieces, quality, secrets, substring_dedup, toxicity, url_filter

QUERIES: dict = {}
ORACLES: dict = {}

#: The words of a text in SQL.
_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(common.documents(spark, sf_dir))


QUERIES["op2_minhash_near_dedup"] = op2_minhash_near_dedup

ORACLES["op2_minhash_near_dedup"] = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, unnest(sh) as g from s),
p as (select x.doc_id as a, y.doc_id as b, count(*) as m from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * m >= 75 * (na.n + nb.n - m)),
g as (select a, b from l union all select b, a from l),
r(doc_id, reached) as (select doc_id, doc_id from n union select r.doc_id, g.b from r join g on r.reached = g.a),
c as (select doc_id, min(reached) as component_id from r group by 1)
select n.doc_id, n.n as n_shingles, component_id, n.doc_id = component_id as kept from n join c using (doc_id)
"""


def op9_quality_rules(spark, sf_dir):
    return quality.quality(common.documents(spark, sf_dir))


QUERIES["op9_quality_rules"] = op9_quality_rules

ORACLES["op9_quality_rules"] = rf"""
with d as (select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as t, {_WORDS} as ws from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from d, unnest(range(1, len(ws) - 1)) u(i)),
again as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct i + k) as n from again, range(3) r(k) group by 1),
l as (select doc_id, host, md5(t) as page, i, string_split(t, chr(10))[i] as line from d, unnest(range(1, len(string_split(t, chr(10))) + 1)) u(i)),
lw as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as own from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct line) as n from lw group by 1),
ln as (select doc_id, host, page, translate(array_to_string(own, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h, sum(len(own)) as w from lw group by 1, 2, 3, 4),
pages as (select host, count(distinct md5(t)) as pages from d group by 1),
f as (select host, h from (select host, h, count(distinct page) as n from ln group by 1, 2) join pages using (host) where n > 10 and n > pages * 0.01),
lost as (select doc_id, sum(w) as lost from ln join f using (host, h) group by 1),
b as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(lost, 0)::bigint as n_frequent_words
    from d left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and n_words - n_frequent_words >= n_words * 0.5 as kept, n_frequent_words from v
"""


def op3_secret_scans(spark, sf_dir):
    # the table names no repository beside its source: the language branch of a source is one
    docs = common.documents(spark, sf_dir)
    return secrets.secrets(docs.withColumn("branch", F.concat_ws("/", "source", "lang")), repo="branch", owner="source")


QUERIES["op3_secret_scans"] = op3_secret_scans


def op6_chat_formatting(spark, sf_dir):
    control = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{control}'), (-7L, 1L, 'assistant', '{control}') as t(conv_id, turn, role, text)")
    messages = chat.fold_events(chat.events_of(rows.unionByName(more)))
    return chat.digests(chat.render(messages))


QUERIES["op6_chat_formatting"] = op6_chat_formatting

_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

ORACLES["op6_chat_formatting"] = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(24 + length(replace({_ESCAPED.format('role')}, chr(10), chr(92) || chr(10))) + length({_ESCAPED.format('text')}))::bigint as formatted_chars
from c group by conv_id
"""


#: The tables hold neither fetch times nor lists. A page is fetched (page_id * 7919) mod 730 days after the
#: start of 2023; every host gets entries by the length of its name and its first letters.
_FETCHED = "timestamp '2023-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 7919 % 730 as int), 0, 0, 0)"


def op10_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url")
    captures = pages.withColumn("fetched", F.expr(_FETCHED.replace("page_id", "id")))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).where("key <> ''").distinct()
    day = lambda n: F.expr(f"timestamp '2023-01-01 00:00:00' + make_interval(0, 0, 0, cast({n} as int), 0, 0, 0)")
    entry = lambda kind, key, action, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"), day(n).alias("at"))
    base = "(ascii(key) * 31 + length(key) * 17) % 200"
    entries = hosts.where("length(key) % 3 <> 0").select(F.inline(F.array(
        entry("domain", F.col("key"), "add", base), entry("domain", F.col("key"), "remove", f"{base} + 150"), entry("domain", F.col("key"), "add", f"{base} + 400"),
        entry("url", F.concat("key", F.lit("/de")), "add", f"{base} + 60"))))
    found = url_filter.as_of_filter(captures, entries)
    return found.select(F.col("id").alias("page_id"), "blocked", "n_active", F.date_format("since", "yyyy-MM-dd").alias("since"))


QUERIES["op10_url_filters"] = op10_url_filters

ORACLES["op10_url_filters"] = r"""
with p as (select page_id, url, timestamp '2023-01-01' + to_days((page_id * 7919 % 730)::int) as fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from pages),
h as (select distinct host as key, (ascii(host) * 31 + length(host) * 17) % 200 as n from p where host <> '' and length(host) % 3 <> 0),
i as (select 'domain' as kind, key, n as since, n + 150 as until from h union all select 'domain', key, n + 400, null from h union all select 'url', key || '/de', n + 60, null from h),
t as (select kind, key, timestamp '2023-01-01' + to_days(since::int) as since, timestamp '2023-01-01' + to_days(until::int) as until from i),
m as (select page_id, t.since from p join t on t.since <= fetched and (until is null or fetched < until) and
    (kind = 'domain' and (host = key or ends_with(host, '.' || key)) or kind = 'url' and (host || path = key or starts_with(host || path, key || '/')))),
g as (select page_id, count(*) as n, max(since) as since from m group by 1)
select page_id, n is not null as blocked, coalesce(n, 0) as n_active, strftime(g.since, '%Y-%m-%d') as since from p left join g using (page_id)
"""


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(common.documents(spark, sf_dir))


QUERIES["op4_substring_dedup"] = op4_substring_dedup

ORACLES["op4_substring_dedup"] = rf"""
with d as (select doc_id, {_WORDS} as ws from documents),
s as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as g from d, unnest(range(1, len(ws) - 18)) u(i)),
c as (select doc_id, i from s qualify row_number() over (partition by g order by doc_id, i) > 1),
gone as (select distinct doc_id, i + k as i from c, range(20) r(k)),
w as (select doc_id, i, ws[i] as word from d, unnest(range(1, len(ws) + 1)) u(i)),
k as (select w.doc_id, count(*) as n, string_agg(word, ' ' order by w.i) as kept from w anti join gone on w.doc_id = gone.doc_id and w.i = gone.i group by 1)
select d.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""


def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("th")


QUERIES["op7_benchmark_decontamination"] = op7_benchmark_decontamination


def op8_line_dedup(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce("_left", F.lit(""))
    return line_dedup.with_lines_left(docs, shortest=line_dedup.ANY_LENGTH).select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.col("_gone").cast("long").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))


QUERIES["op8_line_dedup"] = op8_line_dedup


def op5_sentencepiece(spark, sf_dir):
    tokens = pieces.decoded(pieces.encoded(common.documents(spark, sf_dir)))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


QUERIES["op5_sentencepiece"] = op5_sentencepiece


def op1_toxicity(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("_score").alias("score")
    return toxicity.scored(docs, net).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score, (F.col("_score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op1_toxicity"] = op1_toxicity


def op11_mix_sources(spark, sf_dir):
    return mixing.mixed(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op11_mix_sources"] = op11_mix_sources

ORACLES["op11_mix_sources"] = rf"""
with d as (select doc_id, source, len({_WORDS}) as size from documents),
k as (select *, row_number() over (partition by doc_id, source, size) as nth from d),
q as (select *, ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || size || ':' || nth), 1, 15))::bigint as key from k),
s as (select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by 1),
r as (select *, sum(source_size) over o as filled, sum(w) over () - sum(w) over o as rest, 1.5::double * sum(source_size) over () as budget
    from s window o as (order by source_size / w, source nulls last rows unbounded preceding)),
f as (select *, (2 * filled * w + 2 * source_size * rest)::double <= budget * w as full_up from r),
t as (select source, source_size, case when full_up then (2 * source_size)::double
    else w * (budget - 2 * coalesce(sum(source_size) filter (full_up) over (), 0))::double / sum(w) filter (not full_up) over () end as target from f),
u as (select doc_id, q.source, size, nth, source_size, target, sum(size) over (partition by q.source order by key, doc_id, size, nth rows unbounded preceding) as upto
    from q join t on q.source is not distinct from t.source),
p as (select *, least(256, size - 256 * part) as words, (turn * source_size + upto - size + 256 * part + least(256, size - 256 * part))::double / target as finish
    from u, range(2) a(turn), unnest(range(0, ((size + 255) // 256)::bigint)) b(part) where size > 0),
m as (select *, sum(words) over (order by finish, source nulls last, turn, part rows unbounded preceding) <= 1.5 * (select sum(size) from d) as is_taken from p),
g as (select doc_id, source, size, nth, coalesce(sum(words) filter (is_taken), 0)::bigint as taken from m group by 1, 2, 3, 4)
select u.doc_id, u.size, u.source_size, u.target, coalesce(taken, 0)::bigint as taken from u left join g
    on u.doc_id is not distinct from g.doc_id and u.source is not distinct from g.source and u.size = g.size and u.nth = g.nth
"""


def op12_fill_in_middle(spark, sf_dir):
    made = infill.fill_in_middle(common.documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES["op12_fill_in_middle"] = op12_fill_in_middle

ORACLES["op12_fill_in_middle"] = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
    sha256(t) as restored_sha256 from p
"""


def op13_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved))


QUERIES["op13_hard_negatives"] = op13_hard_negatives

ORACLES["op13_hard_negatives"] = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b as p, p.s as ps, s.b as n, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as r from p join s on p.a = s.a and not same and 30 * p.s <= 100 * s.s and 100 * s.s <= 90 * p.s)
select a as anchor_id, p as positive_id, r::int as rank, n as negative_id, ps as positive_score, ns as negative_score from n where r <= 10
"""
