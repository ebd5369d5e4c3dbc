"""Reviews and verification: ranking features, gates, replies, hashes, merges of candidates and of JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.functions import text as X
from foliogrid.operators import matching
from foliogrid.plans import duck as D
from foliogrid.plans.base import BLOCKS, FORMULAS, blocks, formulas, query
from foliogrid.plans.queue import _EVENTS
from foliogrid.session import table

#: Both dialects read these expressions over: layout_status, layout_confidence, coverage, density, confidence, graph_confidence, rank, blockers, warnings.
_STATUS = "case layout_status when 'pass' then 1.0 when 'review' then 0.55 else 0.0 end"
_SCORE = f"0.38 * {_STATUS} + 0.22 * layout_confidence + 0.16 * coverage + 0.08 * density + 0.08 * confidence + 0.08 * graph_confidence - case when rank <= 1 then 0.0 else least(0.24, 0.12 * (rank - 1)) end - least(0.45, 0.18 * blockers) - least(0.35, 0.035 * warnings)"
_BASE = "case when nodes = 1 and confidence <= 0 then 0.70 else greatest(0.0, least(1.0, confidence)) end"
_RAISED = f"case when coverage > 0 then greatest({_BASE}, least({_BASE} + 0.10, coverage)) else {_BASE} end"
_VERIFIED = f"greatest(0.0, least(1.0, {_RAISED} - least(0.80, 0.35 * blockers + least(0.30, 0.06 * warnings))))"

_CANDIDATES = """c as (select result_id, candidate_id, similarity as confidence, score as graph_confidence, (result_id % 7 / 6.0)::double as coverage, (result_id % 5 / 4.0)::double as density, (result_id % 3 + 1)::int as rank, case when result_id % 9 = 0 then 1 else 0 end as blockers, (result_id % 4)::int as warnings, (result_id % 6)::int as nodes from formulas),
v as (select *, """ + _VERIFIED + """ as layout_confidence from c),
s as (select *, case when blockers > 0 or layout_confidence < 0.35 then 'abstain' when warnings > 0 or layout_confidence < 0.70 then 'review' else 'pass' end as layout_status from v)"""


def verified(spark, sf_dir):
    """Candidates with verification confidence and status."""
    c = formulas(spark, sf_dir).selectExpr("result_id", "candidate_id", "similarity as confidence", "score as graph_confidence", "result_id % 7 / 6.0D as coverage", "result_id % 5 / 4.0D as density", "cast(result_id % 3 + 1 as int) as rank", "if(result_id % 9 = 0, 1, 0) as blockers", "cast(result_id % 4 as int) as warnings", "cast(result_id % 6 as int) as nodes")
    v = c.withColumn("layout_confidence", F.expr(f"cast({_VERIFIED} as double)"))
    return v.withColumn("layout_status", F.expr("case when blockers > 0 or layout_confidence < 0.35 then 'abstain' when warnings > 0 or layout_confidence < 0.70 then 'review' else 'pass' end"))


@query("g14_verification", f"with {FORMULAS}, {_CANDIDATES} select result_id, round(layout_confidence, 6) as layout_confidence, layout_status from s")
def g14(spark, sf_dir):
    return verified(spark, sf_dir).selectExpr("result_id", "round(layout_confidence, 6) as layout_confidence", "layout_status")


_RANK = f"round(greatest(0.0, least(1.0, {_SCORE})), 6)"
_RANK_ORDER = f"verifier_score desc, {_STATUS} desc, layout_confidence desc, confidence desc, rank, result_id"


@query("w07_verifier_ranking", f"with {FORMULAS}, {_CANDIDATES}, k as (select *, {_RANK} as verifier_score from s) select result_id, verifier_score, row_number() over (partition by candidate_id order by {_RANK_ORDER})::int as verifier_rank from k")
def w07(spark, sf_dir):
    """Candidates of a group by verifier score (G15): status, confidence, coverage, less what speaks against them."""
    k = verified(spark, sf_dir).withColumn("verifier_score", F.expr(f"cast({_RANK} as double)"))
    return k.selectExpr("result_id", "verifier_score", f"row_number() over (partition by candidate_id order by {_RANK_ORDER}) as verifier_rank")


_EVAL = {
    "n": "count(*)",
    "exact_rate": "avg(cast(first >= 0.98 as int))",
    "near_rate": "avg(cast(first >= 0.80 as int))",
    "weak_rate": "avg(cast(first >= 0.55 as int))",
    "mean": "avg(first)",
    "nonempty_rate": "avg(cast(said as int))",
    "oracle_exact_rate": "avg(cast(oracle >= 0.98 as int))",
    "oracle_near_rate": "avg(cast(oracle >= 0.80 as int))",
    "oracle_mean": "avg(oracle)",
    "candidates_mean": "avg(candidates)",
    "recommended_exact_rate": "avg(cast(recommended >= 0.98 as int))",
    "recommended_near_rate": "avg(cast(recommended >= 0.80 as int))",
    "recommended_mean": "avg(recommended)",
    "recommended_beyond_first_rate": "avg(cast(recommended_rank > 1 as int))",
    "preferred_exact_rate": "avg(cast(first >= 0.98 as int))",
    "preferred_mean": "avg(first)",
    "review_required_rate": "avg(cast(first_status <> 'pass' as int))",
    "auto_accepted": "sum(0)",
    "abstain_rate": "avg(cast(first_status = 'abstain' as int))",
    "pass_rate": "avg(cast(first_status = 'pass' as int))",
    "review_rate": "avg(cast(first_status = 'review' as int))",
    "usable_exact_rate": "coalesce(avg(case when first_status <> 'abstain' then cast(first >= 0.98 as int) end), 0)",
    "usable_near_rate": "coalesce(avg(case when first_status <> 'abstain' then cast(first >= 0.80 as int) end), 0)",
}
_EVAL_ROUNDED = [f"{sql} as {name}" if name in ("n", "auto_accepted") else f"round({sql}, 6) as {name}" for name, sql in _EVAL.items()]


@query(
    "a22_eval_metrics",
    f"""with {FORMULAS}, {_CANDIDATES}, k as (select s.*, f.latex, {_RANK} as verifier_score, row_number() over (partition by s.candidate_id order by s.rank, s.result_id) as own_rank from s join formulas f using (result_id)),
    b as (select candidate_id, max(confidence) as oracle, arg_min(confidence, own_rank) as first, arg_min(layout_status, own_rank) as first_status, arg_min(trim(latex) <> '', own_rank) as said, count(*) as candidates,
      first(confidence order by verifier_score desc, own_rank) as recommended, first(own_rank order by verifier_score desc, own_rank) as recommended_rank from k group by candidate_id)
    select {', '.join(_EVAL_ROUNDED)} from b""",
)
def a22(spark, sf_dir):
    """Five blocks of figures: the first candidate of each group, the best of n, the one recommended for review, the preferred one, and the layout's gate. None is ever accepted unseen."""
    k = verified(spark, sf_dir).join(formulas(spark, sf_dir).select("result_id", "latex"), "result_id").withColumn("verifier_score", F.expr(f"cast({_RANK} as double)"))
    k = k.withColumn("own_rank", F.expr("row_number() over (partition by candidate_id order by rank, result_id)"))
    top = "max_by(struct(confidence, own_rank), struct(verifier_score, -own_rank))"
    b = k.groupBy("candidate_id").agg(F.max("confidence").alias("oracle"), F.expr("min_by(struct(confidence, layout_status, trim(latex) <> '' as said), own_rank)").alias("f"), F.count("*").alias("candidates"), F.expr(top).alias("r"))
    b = b.selectExpr("oracle", "f.confidence as first", "f.layout_status as first_status", "f.said as said", "candidates", "r.confidence as recommended", "r.own_rank as recommended_rank")
    return b.selectExpr(*_EVAL_ROUNDED)


@query("a21_quality_gate", f"with {FORMULAS}, g as (select stage, avg((similarity >= 0.80)::int) as near, avg(similarity) as mean, count(*) filter (where similarity < 0.55) as low from formulas group by stage) select stage, array_to_string(list_filter([case when near < 0.95 then 'near_rate' end, case when mean < 0.90 then 'mean' end, case when low > 0 then 'low_similarity' end], lambda r: r is not null), ',') as failures from g")
def a21(spark, sf_dir):
    g = formulas(spark, sf_dir).groupBy("stage").agg(F.expr("avg(cast(similarity >= 0.80 as int))").alias("near"), F.avg("similarity").alias("mean"), F.expr("count_if(similarity < 0.55)").alias("low"))
    return g.selectExpr("stage", "array_join(array_compact(array(if(near < 0.95, 'near_rate', null), if(mean < 0.90, 'mean', null), if(low > 0, 'low_similarity', null))), ',') as failures")


@query("a31_source_coverage", f"with {FORMULAS}, f as (select *, result_id % 4 <> 1 as mapped, length(latex) > 20 as selected from formulas), k as (select *, row_number() over (partition by mapped order by result_id) as place from f) select mapped, count(*) as n, count(*) filter (where selected) as selected, string_agg(result_id::varchar, ',' order by result_id) filter (where place <= 12) as sample from k group by mapped")
def a31(spark, sf_dir):
    """Mapped and unmapped sources with a sample of twelve of each, a bounded report."""
    f = formulas(spark, sf_dir).selectExpr("result_id", "result_id % 4 <> 1 as mapped", "length(latex) > 20 as selected")
    n = f.groupBy("mapped").agg(F.count("*").alias("n"), F.expr("count_if(selected)").alias("selected"))
    top = f.withColumn("place", F.expr("row_number() over (partition by mapped order by result_id)")).where("place <= 12").groupBy(F.col("mapped").alias("m")).agg(F.expr("array_join(array_sort(collect_list(result_id)), ',')").alias("sample"))
    return n.join(top, F.col("mapped") == F.col("m")).select("mapped", "n", "selected", "sample")


@query("u01_candidate_sources", f"with {FORMULAS}, u as (select result_id, candidate_id, latex, 'parsed' as src, null::double as score from formulas where stage = 'parsed_blocks' union all select result_id, candidate_id, latex, 'structure', score from formulas where stage = 'pdf_structure' union all select result_id, candidate_id, latex, 'inline', null from formulas where stage = 'inline_spans') select candidate_id, count(*) as n, count(score) as scored, string_agg(distinct src, ',' order by src) as sources from u group by candidate_id")
def u01(spark, sf_dir):
    """Candidates of several sources under one schema; what a source lacks is null."""
    f = formulas(spark, sf_dir)
    a = f.where("stage = 'parsed_blocks'").selectExpr("result_id", "candidate_id", "latex", "'parsed' as src")
    b = f.where("stage = 'pdf_structure'").selectExpr("result_id", "candidate_id", "latex", "'structure' as src", "score")
    c = f.where("stage = 'inline_spans'").selectExpr("result_id", "candidate_id", "latex", "'inline' as src")
    u = b.unionByName(a, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return u.groupBy("candidate_id").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.expr("array_join(array_sort(collect_set(src)), ',')").alias("sources"))


@query("u06_warning_union", f"with {FORMULAS}, w as (select candidate_id, list_filter(list_distinct(list(warning)), lambda x: x <> '') as own, case when candidate_id % 3 = 0 then ['minor', 'late'] else [] end as more from formulas group by candidate_id) select candidate_id, array_to_string(list_sort(list_distinct(list_concat(own, more))), ',') as warnings, len(list_intersect(own, more)) > 0 as shared from w")
def u06(spark, sf_dir):
    """Warnings of several checks in one sorted set, and whether they share any."""
    w = formulas(spark, sf_dir).groupBy("candidate_id").agg(F.expr("filter(collect_set(warning), x -> x <> '')").alias("own")).withColumn("more", F.expr("if(candidate_id % 3 = 0, array('minor', 'late'), array())"))
    return w.selectExpr("candidate_id", "array_join(array_sort(array_union(own, more)), ',') as warnings", "arrays_overlap(own, more) as shared")


@query("f21_recogniser_latex", f"with {FORMULAS}, r as (select result_id, case when result_id % 3 = 0 then '$\\mathrm{{r a t e}}$' when result_id % 3 = 1 then '  $\\cfrac{{1}}{{2}}$ ' else latex end as raw from formulas) select result_id, trim(replace(regexp_replace(trim(trim(raw), '$'), '\\\\(mathrm|text)\\s*\\{{([A-Za-z]) ([A-Za-z]) ([A-Za-z]) ([A-Za-z])\\}}', '\\\\\\1{{\\2\\3\\4\\5}}', 'g'), '\\cfrac', '\\frac')) as latex from r")
def f21(spark, sf_dir):
    """Recognised LaTeX without dollars, with spelled-out words closed up and one kind of fraction."""
    raw = "case when result_id % 3 = 0 then '$\\\\mathrm{r a t e}$' when result_id % 3 = 1 then '  $\\\\cfrac{1}{2}$ ' else latex end"
    r = formulas(spark, sf_dir).selectExpr("result_id", f"trim(both '$' from trim({raw})) as t")
    # in a word command, single letters with blanks between them are one word
    spelled = X.literal(r"(?<=\\(?:mathrm|text)\{(?:[A-Za-z] ){0,8}[A-Za-z]) (?=(?:[A-Za-z] )*[A-Za-z]\})")
    return r.selectExpr("result_id", f"trim(replace(regexp_replace(t, {spelled}, ''), '\\\\cfrac', '\\\\frac')) as latex")


@query("f26_source_titles", r"with t as (select doc_id, '\section*{' || left(replace(replace(text, '{', ''), '}', ''), 40) || ' $x$ \emph{end}}' as src from documents where text is not null) select doc_id, " + D.collapsed(D.sub(D.sub(D.sub(r"regexp_extract(src, '\\(?:chapter|section)\*?(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})+)\}', 1)", r"\$[^$]*\$"), r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{([^{}]*)\})?", r"\1"), "[{}]")) + " as title from t")
def f26(spark, sf_dir):
    """The first heading's title, without mathematics and commands."""
    t = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", f"concat({X.literal(chr(92) + 'section*{')}, left(replace(replace(text, '{{', ''), '}}', ''), 40), {X.literal(' $x$ ' + chr(92) + 'emph{end}}')}) as src".replace("'{{'", "'{'").replace("'}}'", "'}'"))
    found = f"regexp_extract(src, {X.literal(r'\\(?:chapter|section)\*?(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})+)\}')}, 1)"
    bare = X.regex_replace(X.regex_replace(X.regex_replace(found, r"\$[^$]*\$"), r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{([^{}]*)\})?", "$1"), "[{}]")
    return t.selectExpr("doc_id", f"{X.collapsed(bare)} as title")


_REPLY = "case event_id % 4 when 0 then '```json' || chr(10) || '{\"score\": ' || (event_id % 15)::varchar || ', \"risk\": \"a\"}' || chr(10) || '```' when 1 then 'Sure: {\"score\": 0.' || (event_id % 10)::varchar || '} ok' when 2 then 'no json' else '{\"score\": -1}' end"


@query("f35_review_replies", rf"with r as (select event_id, {_REPLY} as reply from events), j as (select event_id, regexp_extract(reply, '(?s)(\{{.*\}})', 1) as body from r) select event_id, body <> '' as parsed, case when body = '' then null else greatest(0.0::double, least(1.0::double, coalesce(try_cast(json_extract_string(case when body = '' then '{{}}' else body end, '$.score') as double), 0.0::double))) end as score, coalesce(json_extract_string(case when body = '' then '{{}}' else body end, '$.risk'), '') as risk from j")
def f35(spark, sf_dir):
    """Replies of a reviewer: fences and chatter off, the outermost object read, scores bounded."""
    parts = "case event_id % 4 when 0 then concat('```json', '\\n', '{\"score\": ', event_id % 15, ', \"risk\": \"a\"}', '\\n', '```') when 1 then concat('Sure: {\"score\": 0.', event_id % 10, '} ok') when 2 then 'no json' else '{\"score\": -1}' end"
    j = table(spark, sf_dir, "events").selectExpr("event_id", f"regexp_extract({parts}, '(?s)(\\\\{{.*\\\\}})', 1) as body")
    return j.selectExpr("event_id", "body <> '' as parsed", "if(body = '', null, greatest(0.0D, least(1.0D, coalesce(try_cast(get_json_object(body, '$.score') as double), 0.0D)))) as score", "coalesce(get_json_object(body, '$.risk'), '') as risk")


@query("f41_source_offsets", "with s as (select doc_id, text, doc_id % 50 + 1 as claimed, substr(text, (doc_id % 50 + 1)::int + (doc_id % 3)::int, 12) as body from documents where length(text) > 80), f as (select *, substr(text, claimed::int, 12) = body as exact, strpos(text, body) as found from s) select doc_id, case when exact then 'exact' when found > 0 then 'relocated' else 'mismatch' end as status, (length(left(text, (case when exact then claimed else found end)::bigint - 1)) - length(replace(left(text, (case when exact then claimed else found end)::bigint - 1), chr(10), '')) + 1)::int as line from f")
def f41(spark, sf_dir):
    """Claimed places of bodies in their sources: right, found elsewhere or not at all; the line they are on."""
    s = table(spark, sf_dir, "documents").where("length(text) > 80").selectExpr("doc_id", "text", "cast(doc_id % 50 + 1 as int) as claimed", "substring(text, cast(doc_id % 50 + 1 as int) + cast(doc_id % 3 as int), 12) as body")
    f = s.selectExpr("*", "substring(text, claimed, 12) = body as exact", "locate(body, text) as found").withColumn("place", F.expr("if(exact, claimed, found)"))
    before = "left(text, place - 1)"
    return f.selectExpr("doc_id", "case when exact then 'exact' when found > 0 then 'relocated' else 'mismatch' end as status", f"length({before}) - length(replace({before}, '\\n', '')) + 1 as line")


@query("g19_content_hashes", f"with {FORMULAS} select result_id, sha256(concat_ws(chr(1), stage, latex, page_num)) as result_hash, sha256('{{\"latex\":\"' || replace(replace(latex, '\\', '\\\\'), '\"', '\\\"') || '\",\"page\":' || page_num || ',\"stage\":\"' || stage || '\"}}') as json_hash from formulas")
def g19(spark, sf_dir):
    """Content addresses: framed fields, and canonical JSON with sorted keys and no blanks."""
    escaped = "replace(replace(latex, '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"
    return formulas(spark, sf_dir).selectExpr("result_id", "sha2(concat_ws(chr(1), stage, latex, page_num), 256) as result_hash", f"sha2(concat('{{\"latex\":\"', {escaped}, '\",\"page\":', page_num, ',\"stage\":\"', stage, '\"}}'), 256) as json_hash")


@query("g23_json_merge", "with m as (select user_id, arg_max(json_extract_string(props, '$.k'), event_id) as k, max(event_type) as kind from events group by user_id) select user_id, 'k=' || k || ',kind=' || kind as merged from m")
def g23(spark, sf_dir):
    """Maps merged key by key, later ones counting, and written in order of keys."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.expr("max_by(get_json_object(props, '$.k'), event_id)").alias("k"), F.max("event_type").alias("kind"))
    both = F.expr("map_from_entries(array_sort(map_entries(map_concat(map('kind', kind), map('k', k)))))")
    return e.withColumn("m", both).selectExpr("user_id", "array_join(transform(map_entries(m), x -> concat(x.key, '=', x.value)), ',') as merged")


@query("p24_query_fallback", "with q as (select item_id, case when item_id % 3 = 0 then '什么' when item_id % 3 = 1 then '什么 ' || left(text, 10) else left(text, 20) end as asked from benchmark) select item_id, regexp_matches(asked, '[\\x{4e00}-\\x{9fff}]') and not regexp_matches(asked, '[A-Za-z0-9_]+') as fallback from q")
def p24(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").selectExpr("item_id", "case when item_id % 3 = 0 then '什么' when item_id % 3 = 1 then concat('什么 ', left(text, 10)) else left(text, 20) end as asked")
    return q.selectExpr("item_id", "asked rlike '[\\\\u4e00-\\\\u9fff]' and not asked rlike '[A-Za-z0-9_]+' as fallback")


@query("j05_resolve_blocks", f"with {BLOCKS}, r as (select doc_id, block_id, content as document from blocks where n % 3 = 0), live as (select doc_id, block_id, block_type, content from blocks where n % 2 = 0) select r.doc_id, r.block_id, coalesce(live.content, trim(r.document)) as content, coalesce(live.block_type, 'paragraph') as block_type, live.content is null as rebuilt from r left join live using (doc_id, block_id) where coalesce(live.content, trim(r.document)) <> ''")
def j05(spark, sf_dir):
    """Retrieved entries as loaded blocks, or rebuilt from what the index holds."""
    b = blocks(spark, sf_dir)
    r = b.where("n % 3 = 0").selectExpr("doc_id", "block_id", "content as document")
    live = b.where("n % 2 = 0").select("doc_id", "block_id", "block_type", "content")
    return r.join(live, ["doc_id", "block_id"], "left").selectExpr("doc_id", "block_id", "coalesce(content, trim(document)) as content", "coalesce(block_type, 'paragraph') as block_type", "content is null as rebuilt").where("content <> ''")


@query("j30_inline_evidence", f"with {FORMULAS}, s as (select candidate_id, {D.collapsed('latex')} as latex, result_id, page_num from formulas where stage in ('inline_spans', 'parsed_blocks')) select candidate_id, latex, min(result_id) as evidence, arg_min(page_num, result_id) as page_num from s group by candidate_id, latex")
def j30(spark, sf_dir):
    s = formulas(spark, sf_dir).where("stage in ('inline_spans', 'parsed_blocks')").selectExpr("candidate_id", f"{X.collapsed('latex')} as latex", "result_id", "page_num")
    return s.groupBy("candidate_id", "latex").agg(F.min("result_id").alias("evidence"), F.expr("min_by(page_num, result_id)").alias("page_num"))


@query("t09_alternatives", f"with {FORMULAS} select candidate_id, array_to_string(list_transform((list_sort(list(struct_pack(s := -score, r := result_id))))[1:3], lambda x: x.r::varchar), ',') as best_three from formulas group by candidate_id")
def t09(spark, sf_dir):
    return formulas(spark, sf_dir).groupBy("candidate_id").agg(F.expr("array_join(transform(slice(array_sort(collect_list(struct(-score as s, result_id as r))), 1, 3), x -> x.r), ',')").alias("best_three"))


@query("q13_knowledge_status", f"with {BLOCKS} select doc_id, count(*) as indexed, count(*) filter (where block_type = 'formula') as formulas, count(*) > 0 as ready from blocks where trim(content) <> '' group by doc_id")
def q13(spark, sf_dir):
    """Index status by document."""
    return blocks(spark, sf_dir).where("trim(content) <> ''").groupBy("doc_id").agg(F.count("*").alias("indexed"), F.expr("count_if(block_type = 'formula')").alias("formulas"), F.expr("count(*) > 0").alias("ready"))


@query("q12_index_upsert", f"with {BLOCKS}, old as (select doc_id, block_id, sha256(content) as hash from blocks where n % 4 <> 0), new as (select doc_id, block_id, sha256(case when n % 5 = 0 then content || '!' else content end) as hash from blocks where n % 3 <> 1) select coalesce(old.doc_id, new.doc_id) as doc_id, count(*) filter (where old.hash is null) as inserted, count(*) filter (where old.hash <> new.hash) as replaced, count(*) filter (where old.hash = new.hash) as skipped, count(*) filter (where new.hash is null) as kept from old full join new on old.doc_id = new.doc_id and old.block_id = new.block_id group by 1")
def q12(spark, sf_dir):
    """An upsert against an index by content: what is new, changed, the same, or not in the batch."""
    b = blocks(spark, sf_dir)
    old = b.where("n % 4 <> 0").selectExpr("doc_id", "block_id", "sha2(content, 256) as old")
    new = b.where("n % 3 <> 1").selectExpr("doc_id", "block_id", "sha2(if(n % 5 = 0, concat(content, '!'), content), 256) as new")
    return old.join(new, ["doc_id", "block_id"], "full_outer").groupBy("doc_id").agg(F.expr("count_if(old is null)").alias("inserted"), F.expr("count_if(old <> new)").alias("replaced"), F.expr("count_if(old = new)").alias("skipped"), F.expr("count_if(new is null)").alias("kept"))


@query("q07_accept_fusion", f"with {FORMULAS}, {_EVENTS}, r as (select candidate_id, first(result_id order by similarity desc, result_id) as best, max(similarity) as s from formulas group by candidate_id) select candidate_id, case when s >= 0.9 then best::varchar else 'manual:' || candidate_id end as result, case when s >= 0.9 then 'existing' else 'manual_revision' end as stage, case when s >= 0.9 then s else 1.0 end as score from r")
def q07(spark, sf_dir):
    """An accepted fusion reuses its result, or makes a manual revision of score 1 (Q8)."""
    r = formulas(spark, sf_dir).groupBy("candidate_id").agg(F.expr("max_by(result_id, struct(similarity, -result_id))").alias("best"), F.max("similarity").alias("s"))
    return r.selectExpr("candidate_id", "if(s >= 0.9, cast(best as string), concat('manual:', candidate_id)) as result", "if(s >= 0.9, 'existing', 'manual_revision') as stage", "if(s >= 0.9, s, 1.0D) as score")


@query("q17_worker_output", f"with {FORMULAS}, o as (select result_id, case when warning = 'empty_result' then 'ocr_empty' when result_id % 8 = 0 then 'cache_miss' when result_id % 11 = 0 then 'crop_failed' else '' end as reason, score, warning from formulas) select result_id, case when reason = '' then 'done' when reason = 'crop_failed' then 'failed' else 'skipped' end as status, reason, reason = '' and (score < 0.65 or warning in ('low_confidence', 'table_like', 'empty_result')) as needs_r2 from o")
def q17(spark, sf_dir):
    """Outcomes of workers as states, and which results go on to the precise round."""
    o = formulas(spark, sf_dir).selectExpr("result_id", "case when warning = 'empty_result' then 'ocr_empty' when result_id % 8 = 0 then 'cache_miss' when result_id % 11 = 0 then 'crop_failed' else '' end as reason", "score", "warning")
    return o.selectExpr("result_id", "case when reason = '' then 'done' when reason = 'crop_failed' then 'failed' else 'skipped' end as status", "reason", "reason = '' and (score < 0.65 or warning in ('low_confidence', 'table_like', 'empty_result')) as needs_r2")


@query("j23_title_matches")
def j23(spark, sf_dir):
    """Titles of sources to a document's outline: the outline has every other heading, a source's title lacks a letter now and then."""
    b = blocks(spark, sf_dir).where("block_type = 'heading'").selectExpr("doc_id", "n", "page_num", f"{X.regex_replace('lower(content)', '[^a-z0-9]+')} as title").where("title <> ''")
    outline = b.where("n % 2 = 0").groupBy("doc_id", "title").agg(F.min_by("page_num", "n").alias("page_num"))
    asked = b.selectExpr("doc_id", "if(n % 3 = 1, concat(left(title, 3), substring(title, 5)), title) as asked").where("asked <> ''").distinct()
    return matching.titles_to_outline(asked, outline)
