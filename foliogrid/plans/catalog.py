"""Names and routes of services, caches, and the audits that look at rows from several sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.functions import services as V
from foliogrid.functions import text as X
from foliogrid.operators import caches
from foliogrid.plans import duck as D
from foliogrid.plans.base import BLOCKS, FORMULAS, GLYPHS, blocks, formulas, glyphs, query
from foliogrid.session import table

_MODELS = ("", " deepseek-chat ", "DeepSeek-Reasoner", "openai/gpt-4o", "glm-4", "moonshot-v1-8k", "deepseek/deepseek-v4-pro", "Qwen/qwen-plus")
_MODEL_LIST = ", ".join(f"'{m}'" for m in _MODELS)
_FULL = "case when lower(t) in ('deepseek-chat', 'deepseek/deepseek-chat') then 'deepseek/deepseek-v4-flash' when t = '' or contains(t, '/') then t when starts_with(lower(t), 'deepseek') then 'deepseek/' || t else t end"


_NAMES = [f"trim(regexp_replace(upper({c}), '[^A-Z0-9]+', '_', 'g'), '_')" for c in ("t", "full_name", "family")]


@query(
    "f37_model_names",
    f"""with m as (select c_custkey, [{_MODEL_LIST}][(c_custkey % {len(_MODELS)} + 1)::int] as model from customer), t as (select *, trim(model) as t from m), n as (select *, {_FULL} as full_name from t),
    k as (select *, case when contains(full_name, '/') then split_part(full_name, '/', 1) else split_part(full_name, '-', 1) end as family from n)
    select c_custkey, full_name, family, case full_name {' '.join(f"when '{a}' then '{b}'" for a, b in V.SHOWN.items())} when '' then 'Mock' else case when contains(full_name, '/') then substr(full_name, strpos(full_name, '/') + 1) else full_name end end as shown,
      array_to_string(list_transform(list_filter([{', '.join(_NAMES)}], lambda x, i: x <> '' and list_position([{', '.join(_NAMES)}], x) = i), lambda x: x || '_API_KEY'), ',') as names_all from k""",
)
def f37(spark, sf_dir):
    """A model's full name, family, shown name, and the variables that may hold its key."""
    m = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"element_at(array({_MODEL_LIST}), cast(c_custkey % {len(_MODELS)} + 1 as int)) as model")
    return m.selectExpr("c_custkey", f"{V.model_name('model')} as full_name", f"{V.family('model')} as family", f"{V.shown_name('model')} as shown", f"{V.key_names('model')} as names").selectExpr("c_custkey", "full_name", "family", "shown", "array_join(names, ',') as names_all")


_TASKS, _STRATEGIES = ("embedding", "translation", "qa", "summarization"), ("local_only", "cloud_only", "local_first")
_ROUTE = """case when task = 'embedding' then case when loc then 'local' when cloud then 'cloud' end when strategy = 'local_only' then case when loc then 'local' end
  when strategy <> 'cloud_only' and loc then 'local' when task in ('qa', 'summarization') and thinks then 'reasoning' when cloud then 'cloud' when thinks then 'reasoning' when back then 'fallback' end"""


@query("x19_service_routes", f"with r as (select event_id, {list(_TASKS)!r}[(event_id % 4 + 1)::int] as task, {list(_STRATEGIES)!r}[(event_id // 4 % 3 + 1)::int] as strategy, user_id % 2 = 0 as loc, user_id % 3 = 0 as cloud, user_id % 5 = 0 as thinks, user_id % 7 <> 0 as back from events) select event_id, coalesce({_ROUTE}, 'none') as service from r")
def x19(spark, sf_dir):
    """Which service takes each request, by strategy and by what is there."""
    one = lambda xs, i: f"element_at(array({', '.join(repr(x) for x in xs)}), cast({i} + 1 as int))"
    r = table(spark, sf_dir, "events").selectExpr("event_id", f"{one(_TASKS, 'event_id % 4')} as task", f"{one(_STRATEGIES, 'event_id div 4 % 3')} as strategy", "user_id % 2 = 0 as loc", "user_id % 3 = 0 as cloud", "user_id % 5 = 0 as thinks", "user_id % 7 <> 0 as back")
    return r.selectExpr("event_id", f"coalesce({V.route('task', 'strategy', 'loc', 'cloud', 'thinks', 'back')}, 'none') as service")


@query("x18_cache_replay")
def x18(spark, sf_dir):
    """Caches of 2,000 units replayed from requests: hits, evictions and size; a user's requests are a cache here."""
    r = table(spark, sf_dir, "events").selectExpr("user_id as cache", "event_id as seq", "case event_type when 'view' then 'get' when 'signup' then 'drop' else 'put' end as action", "cast(event_id % 23 as string) as `key`", "100 + event_id % 300 as size")
    return caches.replayed(r, 2_000)


@query("j10_positional_zip", f"with {FORMULAS}, a as (select result_id, row_number() over (order by result_id) as place from formulas where result_id % 3 <> 0), b as (select result_id, row_number() over (order by result_id) as place from formulas where result_id % 4 <> 0) select place::bigint as place, a.result_id as left_id, b.result_id as right_id, coalesce(a.result_id = b.result_id, false) as same from a full join b using (place)")
def j10(spark, sf_dir):
    """Two sorted files side by side: rows are numbered in parallel, a file's parts by their counts, and meet on the number."""
    f = formulas(spark, sf_dir)
    return numbered(f.where("result_id % 3 <> 0"), "result_id", "left_id").join(numbered(f.where("result_id % 4 <> 0"), "result_id", "right_id"), "place", "full_outer").selectExpr("place", "left_id", "right_id", "coalesce(left_id = right_id, false) as same")


def numbered(rows, key: str, name: str):
    """(place, name): keys with their place in order, from 1 on; each task numbers its range, the ranges' counts give the offsets."""
    from foliogrid.session import cut

    sorted_rows = cut(rows.select(F.col(key).alias(name)).repartitionByRange(name).sortWithinPartitions(name).withColumn("mono", F.monotonically_increasing_id()))
    own = sorted_rows.select(name, F.shiftright("mono", 33).alias("part"), (F.col("mono").bitwiseAND((1 << 33) - 1) + 1).alias("own"))
    counts = own.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("p"), F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    return own.join(F.broadcast(before), F.col("part") == F.col("p")).select((F.col("own") + F.col("before")).alias("place"), name)


@query(
    "j28_scoped_cache",
    "with c as (select 'm' || (event_id % 3) as model, 'i' || (user_id % 40) as image, arg_max(value, event_id) as latex from events where event_type = 'purchase' group by all), r as (select event_id, 'i' || (user_id % 60) as image, case when event_id % 4 = 3 then '' else 'm' || (event_id % 4) end as model from events where event_type = 'view'), a as (select image, min(model) as any_model, arg_min(latex, model) as latex from c group by image) select r.event_id, case when s.latex is not null then 'scoped' when r.model = '' and a.latex is not null then 'image' else 'miss' end as outcome, coalesce(s.latex, case when r.model = '' then a.latex end) as latex from r left join c s on s.image = r.image and s.model = r.model left join a on a.image = r.image",
)
def j28(spark, sf_dir):
    """Cached results by model and image; a request without a model takes any model's, the first by name."""
    e = table(spark, sf_dir, "events")
    c = e.where("event_type = 'purchase'").selectExpr("concat('m', event_id % 3) as model", "concat('i', user_id % 40) as image", "value", "event_id").groupBy("model", "image").agg(F.max_by("value", "event_id").alias("scoped"))
    r = e.where("event_type = 'view'").selectExpr("event_id", "concat('i', user_id % 60) as image", "if(event_id % 4 = 3, '', concat('m', event_id % 4)) as model")
    a = c.groupBy("image").agg(F.min_by("scoped", "model").alias("any"))
    return r.join(c, ["model", "image"], "left").join(a, "image", "left").selectExpr("event_id", "case when scoped is not null then 'scoped' when model = '' and any is not null then 'image' else 'miss' end as outcome", "coalesce(scoped, if(model = '', any, null)) as latex")


@query("a05_cache_stats", "with r as (select event_type, user_id % 50 as block_id, event_id from events), p as (select block_id, min(event_id) as put from r where event_type = 'purchase' group by block_id), g as (select r.*, coalesce(p.put < r.event_id, false) as hit from r left join p using (block_id) where event_type <> 'purchase') select event_type, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, round(avg(hit::int), 6) as hit_rate from g group by event_type")
def a05(spark, sf_dir):
    """Hits, misses and hit rate by kind of request: a request hits if its key was put before."""
    r = table(spark, sf_dir, "events").selectExpr("event_type", "user_id % 50 as block_id", "event_id")
    p = r.where("event_type = 'purchase'").groupBy("block_id").agg(F.min("event_id").alias("put"))
    g = r.where("event_type <> 'purchase'").join(p, "block_id", "left").withColumn("hit", F.expr("coalesce(put < event_id, false)"))
    return g.groupBy("event_type").agg(F.expr("count_if(hit)").alias("hits"), F.expr("count_if(not hit)").alias("misses"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


@query("p06_pending_formulas", f"with {BLOCKS} select doc_id, block_id from blocks where block_type = 'formula' and n % 3 <> 0 and coalesce(case n % 5 when 0 then true when 1 then null else false end, false) = false")
def p06(spark, sf_dir):
    """Formula blocks that wait for recognition."""
    b = blocks(spark, sf_dir).selectExpr("doc_id", "block_id", "block_type", "if(n % 3 = 0, if(n % 2 = 0, false, null), true) as needs_ocr", "case n % 5 when 0 then true when 1 then null else false end as recognised")
    return b.where(X.pending_formula("block_type", "needs_ocr", "recognised")).select("doc_id", "block_id")


@query("f14_paragraphs", "with p as (select doc_id, unnest(list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) as p from documents where text is not null) select doc_id, count(*) as n, md5(string_agg(md5(p), '' order by md5(p))) as paragraphs from p group by doc_id")
def f14(spark, sf_dir):
    """Paragraphs of clean text: what stands between blank lines; sentences' ends stand for blank lines here."""
    p = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "explode(filter(transform(split(replace(text, '. ', '.\\n\\n'), '\\n\\n'), x -> trim(both ' \\t\\n\\r' from x)), x -> x <> '')) as p")
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.expr("md5(array_join(array_sort(collect_list(md5(p))), ''))").alias("paragraphs"))


@query("f33_evidence_context", f"with {BLOCKS}, e as (select doc_id, row_number() over (partition by doc_id order by n) as k, page_num, block_type, case when n % 2 = 0 then left(content, 12) else '' end as section, content from blocks where trim(content) <> '') select doc_id, md5(string_agg('[S' || k || '] 相关片段 · 第' || (page_num + 1) || '页 · ' || block_type || case when section = '' then '' else ' · ' || section end || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by k)) as context_md5 from e where k <= 8 group by doc_id")
def f33(spark, sf_dir):
    """The sources of an answer as one text: numbered, with page, kind and section, between rules."""
    e = blocks(spark, sf_dir).where("trim(content) <> ''").selectExpr("doc_id", "row_number() over (partition by doc_id order by n) as k", "page_num", "block_type", "if(n % 2 = 0, left(content, 12), '') as section", "content").where("k <= 8")
    line = X.evidence_block("concat('S', k)", "'相关片段'", "page_num", "block_type", "section", "content")
    return e.groupBy("doc_id").agg(F.expr(f"md5(array_join(transform(array_sort(collect_list(struct(k, {line} as line))), s -> s.line), '\\n\\n---\\n\\n'))").alias("context_md5"))


@query("f23_font_names", rf"with {GLYPHS}, n as (select distinct case when cid % 4 = 0 then 'AB+' || font when cid % 4 = 1 then 'abcdef+' || font when cid % 4 = 2 then 'TOOLONGPREFIX+' || font else 'LM ' || font end as font from glyphs) select font, regexp_replace(font, '^[A-Z]{{6}}\+', '') as plain, replace(regexp_replace(font, '^[^+]{{0,8}}\+', ''), ' ', '') as family from n")
def f23(spark, sf_dir):
    """Fonts without their subset's prefix, by the rule of pages and by that of training data."""
    n = glyphs(spark, sf_dir).selectExpr("case cid % 4 when 0 then concat('AB+', font) when 1 then concat('abcdef+', font) when 2 then concat('TOOLONGPREFIX+', font) else concat('LM ', font) end as font").distinct()
    return n.selectExpr("font", f"{X.font_name('font')} as plain", f"{X.font_family('font')} as family")


@query("f16_match_parts", f"with {FORMULAS}, n as (select result_id, {D.formula_normal('latex')} || ' \\frac a_1' as normal from formulas), c as (select *, {D.sub('normal', '[_{}]')} as compact from n) select result_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(normal, '[a-z]{{2,}}|[0-9]+'), list_filter([case when length(compact) >= 4 then left(compact, 4) end, case when length(compact) >= 6 then left(compact, 6) end, case when length(compact) >= 8 then left(compact, 8) end], lambda h: h is not null)), list_filter(string_split_regex(replace(compact, '\\', ''), '\\s+'), lambda w: w <> '')))), ' ') as tokens from c")
def f16(spark, sf_dir):
    """Match tokens of training data: also what stands between blanks."""
    n = formulas(spark, sf_dir).selectExpr("result_id", f"concat({X.formula_normal('latex')}, ' \\\\frac a_1') as normal")
    return n.selectExpr("result_id", f"array_join({X.match_tokens('normal', parts=True)}, ' ') as tokens")


_PDF = "(result_id % 3 = 0) as has_rule, (result_id % 4 = 1) as has_script, (result_id % 5 <> 2) as has_math, (result_id % 6)::int as inked, case result_id % 3 when 0 then 'display' when 1 then 'inline' else '' end as kind"


@query("f38_coverage_tags", f"with {FORMULAS}, f as (select result_id, latex, {_PDF} from formulas) select result_id, array_to_string(list_sort(list_distinct(list_concat({D.coverage_tags('latex')}, list_filter([nullif(kind, ''), case when has_rule then 'horizontal_rule' end, case when has_script then 'script_size_pdf_evidence' end, case when has_math then 'math_font_pdf_evidence' end, case when inked <= 1 then 'single_glyph_or_empty_text' end], lambda t: t is not null)))), ',') as tags from f")
def f38(spark, sf_dir):
    """Coverage tags of a formula from its LaTeX and from what its page shows."""
    f = formulas(spark, sf_dir).selectExpr("result_id", "latex", "result_id % 3 = 0 as has_rule", "result_id % 4 = 1 as has_script", "result_id % 5 <> 2 as has_math", "cast(result_id % 6 as int) as inked", "case result_id % 3 when 0 then 'display' when 1 then 'inline' else '' end as kind")
    return f.selectExpr("result_id", f"array_join({X.coverage_tags('latex', 'kind', 'has_rule', 'has_script', 'has_math', 'inked')}, ',') as tags")
