"""The registered training-data queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, jaccard_join, line_dedup, mixing, quality_rules, quality_trees, repeat_index, secret_scan, tool_calls, url_lists, warc, whitening
from .common import load, n_words_of


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_to_targets(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_index.remove_repeats(load(spark, sf_dir, "documents"))


def op3_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The tools that the turns of conversations are read as calls of.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", True), ("lookup", "query", "string", True), ("lookup", "limit", "integer", False), ("count", "limit", "integer", True)]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as calls, which depend on the call of half their turn; the turns after them as results."""
    rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("count")), (F.length(text) % 3 + 1).cast("int"))
    arguments = F.concat(F.lit('{"query": "'), F.regexp_extract(text, "[a-z]+", 0), F.lit('", "limit": '), n_words_of(text).cast("string"), F.lit("}"))
    calls = rows.where("role = 'assistant'").select(ident(F.col("turn")).alias("call_id"), "conv_id", "turn", name.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") > 1, F.array(ident(F.floor((F.col("turn") - 1) / 2)))).alias("depends_on"))
    results = rows.where("role <> 'assistant' and turn > 0").select(ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(load(spark, sf_dir, "conversations"))
    schemas = spark.sql("select * from values " + ", ".join(f"('{n}', '{p}', '{t}', {str(r).lower()})" for n, p, t, r in TOOLS) + " as t(name, param, type, required)")
    out = tool_calls.link_calls(calls, results, schemas)
    return out.select("call_id", "conv_id", "position", "level", "n_results", "errors", "valid", "canonical")


OP6_SQL = """
with recursive rows as (
  select *, coalesce(text, '') as t from conversations where conv_id is not null and turn is not null),
raw as (
  select conv_id || '-' || turn as call_id, conv_id, turn, ['search', 'lookup', 'count'][length(t) % 3 + 1] as name,
    regexp_extract(t, '[a-z]+') as q, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as n,
    case when turn > 1 then conv_id || '-' || (turn - 1) // 2 end as dep
  from rows where role = 'assistant'),
calls as (
  select distinct on (call_id) * from raw
  order by call_id, name, '{"query": "' || q || '", "limit": ' || n || '}'),
edges as (select c.call_id, c.dep from calls c join calls d on c.dep = d.call_id),
depth as (
  select call_id, 0 as level from calls where call_id not in (select call_id from edges)
  union all
  select e.call_id, d.level + 1 from edges e join depth d on e.dep = d.call_id),
lev as (select call_id, max(level) as level from depth group by 1),
answers as (select conv_id || '-' || (turn - 1) as call_id, count(*) as k from rows where role <> 'assistant' and turn > 0 group by 1),
told as (
  select c.*, l.level, coalesce(a.k, 0) as k, case when c.name = 'count' then 'unknown:query' else '' end as errors
  from calls c left join lev l using (call_id) left join answers a using (call_id))
select call_id, conv_id,
  cast(row_number() over (partition by conv_id order by level is null, level, turn, call_id) as bigint) as position,
  cast(level as bigint) as level, cast(k as bigint) as n_results, errors, errors = '' as valid,
  '{"arguments":{"limit":' || n || ',"query":"' || q || '"},"id":"' || call_id || '","name":"' || name || '"}' as canonical
from told
"""


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries: hosts are listed from captures with a query and taken off by those with a fragment;
    the parents of hosts are listed by plain http captures and taken off by the others."""
    rows = pages.select(F.col("page_id").cast("long").alias("at"), "url", url_lists.host_of(F.col("url")).alias("host")).where("host is not null")
    action = F.when(F.instr("url", "?") > 0, "add").when(F.instr("url", "#") > 0, "remove")
    hosts = rows.select(F.concat(F.lit("host:"), "host").alias("list_key"), (F.col("at") * 60).alias("at"), action.alias("action"))
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    parents = rows.where(F.instr("host", ".") > 0).select(F.concat(F.lit("domain:"), parent).alias("list_key"), (F.col("at") * 60).alias("at"), F.when(F.col("url").startswith("http://"), "add").otherwise("remove").alias("action"))
    return hosts.unionByName(parents)


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") * 60 + 30).alias("fetched"))
    return url_lists.filter_captures(captures, entries_of(pages))


OP9_SQL = """
with p as (
  select page_id, url, nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.$', '')), '') as host from pages),
e as (
  select 'host:' || host as k, page_id * 60 as ts, case when contains(url, '?') then 1 when contains(url, '#') then 0 end as a from p where host is not null
  union all
  select 'domain:' || regexp_replace(host, '^[^.]+\\.', ''), page_id * 60, case when url like 'http://%' then 1 else 0 end from p where host is not null and contains(host, '.')),
f as (select k, ts, max(a) as a from e where a is not null and ts is not null group by k, ts),
keys as (
  select page_id, url, page_id * 60 + 30 as ts, 'host:' || host as k from p where host is not null
  union
  select page_id, url, page_id * 60 + 30, 'domain:' || array_to_string(string_split(host, '.')[i:], '.')
  from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from p where host is not null)),
hit as (select keys.page_id, keys.url, keys.ts, keys.k from keys asof join f on keys.k = f.k and keys.ts >= f.ts where f.a = 1),
n as (select page_id, url, ts, count(*) as n, string_agg(k, ',' order by k) as rules from hit group by all)
select p.page_id, p.url, p.page_id * 60 + 30 as fetched, cast(coalesce(n.n, 0) as bigint) as n_active,
  coalesce(rules, '') as rules, n.n is not null as blocked
from p left join n on p.page_id = n.page_id and p.url = n.url
"""


def op7_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.host_level_rules(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_bad", "bad_rules")


def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_similar(load(spark, sf_dir, "documents"), n=4, percent=85)


OP8_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 4 then [w[i:i + 3] for i in range(1, len(w) - 2)] when len(w) > 0 then [w] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.c as component_id
from documents d left join n using (doc_id) join (select a, min(b) as c from reach group by 1) c on c.a = d.doc_id
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.link_credentials(load(spark, sf_dir, "documents"))


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.rewrite(load(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as l, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (
  select *, len(l) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from k),
p as (
  select *, array_to_string(l[1:a], '') as pre, array_to_string(l[a + 1:b], '') as mid, array_to_string(l[b + 1:], '') as suf from c)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_repeat_index": op2_repeat_index,
        "op3_warc_normalise": op3_warc_normalise,
        "op4_template_leaks": op4_template_leaks,
        "op5_fuzzy_lines": op5_fuzzy_lines,
        "op6_tool_calls": op6_tool_calls,
        "op7_host_quality_rules": op7_host_quality_rules,
        "op8_signature_trees": op8_signature_trees,
        "op9_url_lists": op9_url_lists,
        "op10_secret_scan": op10_secret_scan,
        "op11_whiten_embeddings": op11_whiten_embeddings,
        "op12_quality_trees": op12_quality_trees,
        "op13_fill_middle": op13_fill_middle,
    }


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
r as (select payload_digest, max(page_id) as first, count(*) as n from d where payload_bytes >= 1000 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when r.n > 1 and d.page_id <> r.first then 'revisit' else 'response' end as record_type,
  case when r.n > 1 and d.page_id <> r.first then r.first end as refers_to, true as intact
from d left join r on d.payload_digest = r.payload_digest and d.payload_bytes >= 1000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_normalise": OP3_SQL, "op6_tool_calls": OP6_SQL, "op8_signature_trees": OP8_SQL, "op9_url_lists": OP9_SQL, "op13_fill_middle": OP13_SQL}
