"""Training datasets: admission, splits, manifests, audits, confusion, class weights and glossaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.functions import audit as A
from foliogrid.functions import text as X
from foliogrid.plans import duck as D
from foliogrid.plans.base import BLOCKS, FORMULAS, GLYPHS, blocks, formulas, glyphs, query
from foliogrid.session import table

TRAIN, VALIDATION = 0.8, 0.1
SEED = "tinyset"


def split_name(key: str, sha: str, to_number: str) -> str:
    """The split of a group by the first 12 hex digits of a hash of seed and key; both dialects read it."""
    value = to_number.format(f"left({sha.format(key)}, 12)") + " / 281474976710655.0"
    return f"case when {value} < {TRAIN} then 'train' when {value} < {TRAIN + VALIDATION} then 'validation' else 'test' end"


_SPLIT_SQL = split_name("h", "{0}", "('0x' || {0})::bigint::double")


@query("g18_split", "with s as (select doc_id, source || ':' || lang as g from documents where source is not null), h as (select *, sha256('{\"group\":\"' || g || '\",\"seed\":\"" + SEED + "\"}') as h from s) select doc_id, g as group_key, " + _SPLIT_SQL + " as split from h")
def g18(spark, sf_dir):
    """Deterministic split by group: all rows of a group share one."""
    s = table(spark, sf_dir, "documents").where("source is not null").selectExpr("doc_id", "concat(source, ':', lang) as group_key")
    h = s.withColumn("h", F.expr(f"sha2(concat('{{\"group\":\"', group_key, '\",\"seed\":\"{SEED}\"}}'), 256)"))
    return h.selectExpr("doc_id", "group_key", f"{split_name('h', '{0}', 'cast(conv({0}, 16, 10) as double)')} as split")


_ROWS = """result_id % 13 <> 0 as exact_box, case when result_id % 17 = 0 then 'v1' else 'v2' end as quality_version, 'v2' as wanted_version, {upstream} as upstream, case when result_id % 11 = 0 then ' ' else latex end as label, x1 > x0 and y1 > y0 and result_id % 29 <> 0 as has_box, result_id % 5 as nodes"""


def _captured(dialect: A.Spark) -> str:
    return _ROWS.format(upstream=dialect.kept("case when warning = 'empty_result' then 'empty_marker_capture' end", "case when result_id % 7 = 0 then '' end", "case when result_id % 19 = 0 then 'source_offset_not_verified' end"))


@query("p28_row_blockers", f"with {FORMULAS}, r as (select result_id, {_captured(A.Duck())} from formulas), b as (select {A.row_blockers(A.Duck())} as blockers from r) select blocker, count(*) as n from (select unnest(case when len(blockers) = 0 then ['admitted'] else blockers end) as blocker from b) group by blocker")
def p28(spark, sf_dir):
    """Why captured rows are kept out of a data set, counted; rows without a reason are admitted."""
    r = formulas(spark, sf_dir).selectExpr("result_id", *_split(_captured(A.Spark())))
    b = r.selectExpr(f"{A.row_blockers(A.Spark())} as blockers")
    return b.select(F.explode(F.expr("if(size(blockers) = 0, array('admitted'), blockers)")).alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


def _split(columns: str) -> list[str]:
    """Columns of a select list, cut at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


@query(
    "a25_manifest",
    f"""with {FORMULAS}, r as (select result_id, stage, latex, length(latex) as n, {_captured(A.Duck())} from formulas), b as (select *, {A.row_blockers(A.Duck())} as blockers, sha256(stage || ':' || latex) as input_hash from r),
    ok as (select * from b where len(blockers) = 0), t as (select stage, unnest({D.coverage_tags('latex')}) as tag from ok),
    h as (select stage, sha256(string_agg(input_hash, ',' order by result_id)) as dataset_hash, count(*) as row_count, min(n)::int as least, max(n)::int as most, round(avg(n), 3) as mean, (list_sort(list(n)))[least(count(*) - 1, round_even((count(*) - 1) * 0.95::double, 0)::bigint) + 1]::int as p95 from ok group by stage),
    tg as (select stage, string_agg(tag || ':' || k, ',' order by tag) as tags from (select stage, tag, count(*) as k from t group by all) group by stage),
    bl as (select stage, string_agg(blocker || ':' || k, ',' order by blocker) as blocked from (select stage, blocker, count(*) as k from (select stage, unnest(blockers) as blocker from b) group by all) group by stage)
    select h.*, coalesce(tags, '') as tags, coalesce(blocked, '') as blocked from h left join tg using (stage) left join bl using (stage)""",
)
def a25(spark, sf_dir):
    """A manifest by stage: admitted rows and their hash, lengths with p95 by nearest rank (G17), tags, and what blocked the others."""
    r = formulas(spark, sf_dir).selectExpr("result_id", "stage", "latex", "length(latex) as n", *_split(_captured(A.Spark())))
    b = r.selectExpr("result_id", "stage", "latex", "n", f"{A.row_blockers(A.Spark())} as blockers", "sha2(concat(stage, ':', latex), 256) as input_hash")
    ok = b.where("size(blockers) = 0")
    nearest = "sort_array(collect_list(n))[cast(least(count(*) - 1, bround((count(*) - 1) * 0.95D, 0)) as int)]"
    whole = "sha2(array_join(transform(array_sort(collect_list(struct(result_id, input_hash))), s -> s.input_hash), ','), 256)"
    h = ok.groupBy("stage").agg(F.expr(whole).alias("dataset_hash"), F.count("*").alias("row_count"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean"), F.expr(nearest).alias("p95"))

    def listed(rows, item: str, name: str):
        one = rows.groupBy("stage", item).agg(F.count("*").alias("k"))
        return one.groupBy("stage").agg(F.expr(f"array_join(transform(array_sort(collect_list(struct({item}, k))), s -> concat(s.{item}, ':', s.k)), ',')").alias(name))

    tags = listed(ok.selectExpr("stage", f"explode({X.coverage_tags('latex')}) as tag"), "tag", "tags")
    blocked = listed(b.selectExpr("stage", "explode(blockers) as blocker"), "blocker", "blocked")
    return h.join(tags, "stage", "left").join(blocked, "stage", "left").na.fill("", ["tags", "blocked"])


_AUDITED = """result_id, case result_id % 16 when 3 then 'algorithm_block' when 5 then 'diagram' when 7 then 'image_formula' else 'display' end as candidate_kind, case when result_id % 31 = 1 then 'possible_chemistry' else 'math_ai' end as domain,
  case when result_id % 37 = 2 then 'scanned' else 'born_digital' end as document_kind, case when result_id % 41 = 3 then 'unsupported' else '' end as recommended_route, result_id % 43 = 4 as needs_ocr, case when result_id % 47 = 5 then ' ' else latex end as latex, result_id % 9 <> 8 as has_tree,
  {warnings} as target_warnings, {artifacts} as artifacts, result_id % 53 <> 6 as aligned, similarity as hard_rate, (result_id % 3)::int as unmatched, {found} as alignment_warnings, result_id % 59 <> 7 as has_glyphs,
  contains(latex, 'sqrt') as has_sqrt, contains(latex, 'frac') as has_fraction, contains(latex, 'text') as has_text, contains(latex, '=') as has_atom, {tags} as tags"""


def _audited(d: A.Spark, tags: str) -> str:
    texts = {
        "warnings": d.kept("case when result_id % 10 = 8 then 'target_tree_unsupported_katex_type:cr' end", "case when result_id % 10 = 6 then 'target_tree_radical_missing_body' end", "case when result_id % 10 = 4 then 'katex_parse_error:x' end"),
        "artifacts": d.kept("'spacing'", "case when result_id % 14 = 2 then 'unsupported_katex_node' end", "case when result_id % 14 = 9 then 'katex_error_color' end"),
        "found": d.kept("case when similarity < 0.7 then 'alignment_low_hard_coverage' end", "case when result_id % 3 > 0 then 'alignment_unmatched_target_nodes' end", "'other'"),
        "tags": tags,
    }
    out = _AUDITED.format(**texts)
    return out if isinstance(d, A.Duck) else out.replace("(result_id % 3)::int", "cast(result_id % 3 as int)")


def _audit_steps(d: A.Spark) -> list[list[str]]:
    """Columns step by step: reasons, bucket, and what follows from them."""
    return [[f"{sql} as {name}" for name, sql in A.reasons(d).items()], [f"{A.bucket(d)} as bucket", f"{A.bucket_reasons(d)} as why", f"{A.secondary(d)} as also"], [f"{A.blocker_tags(d)} as blockers", f"{A.quality()} as quality", f"{A.recommended()} as route"]]


_AUDIT = f"{FORMULAS}, q0 as (select {_audited(A.Duck(), D.coverage_tags('latex'))} from formulas), " + ", ".join(f"q{i} as (select *, {', '.join(cols)} from q{i - 1})" for i, cols in enumerate(_audit_steps(A.Duck()), 1))


def audited(spark, sf_dir):
    q = formulas(spark, sf_dir).selectExpr(*_split(_audited(A.Spark(), X.coverage_tags("latex"))))
    for cols in _audit_steps(A.Spark()):
        q = q.selectExpr("*", *cols)
    return q


@query("f40_bucket_cascade", f"with {_AUDIT} select result_id, bucket, array_to_string(why, ',') as reasons, array_to_string(also, ',') as secondary_buckets, array_to_string(blockers, ',') as blocker_tags, quality, route from q3")
def f40(spark, sf_dir):
    """Each row's bucket with its reasons, the buckets it could be in besides, what blocks it, and the route that it takes."""
    return audited(spark, sf_dir).selectExpr("result_id", "bucket", "array_join(why, ',') as reasons", "array_join(also, ',') as secondary_buckets", "array_join(blockers, ',') as blocker_tags", "quality", "route")


_AUDIT_COUNTS = {"bucket": "array(bucket)", "coverage": "tags", "ready_coverage": "if(bucket = 'ready_for_model', tags, array())", "reason": "why", "blocker": "blockers"}
_DUCK_COUNTS = {"bucket": "[bucket]", "coverage": "tags", "ready_coverage": "case when bucket = 'ready_for_model' then tags else [] end", "reason": "why", "blocker": "blockers"}


@query("a24_coverage_audit", f"with {_AUDIT}, c as (" + " union all ".join(f"select '{k}' as kind, unnest({v}) as item from q3" for k, v in _DUCK_COUNTS.items()) + f") select kind, item, count(*) as n from c group by all union all select 'missing_' || k, w, 0 from (select unnest({list(X.COVERAGE)!r}) as w), (select unnest(['coverage', 'ready_coverage']) as k) where not exists (select 1 from c where c.kind = k and c.item = w)")
def a24(spark, sf_dir):
    """Rows by bucket, coverage, coverage of ready rows, reason and blocker, and the tags that are missing (U4)."""
    listed = ", ".join(f"named_struct('kind', '{k}', 'items', {v})" for k, v in _AUDIT_COUNTS.items())
    c = audited(spark, sf_dir).selectExpr(f"inline(array({listed}))").selectExpr("kind", "explode(items) as item").groupBy("kind", "item").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(k, t) for k in ("coverage", "ready_coverage") for t in X.COVERAGE], "kind string, item string")
    missing = wanted.join(c, ["kind", "item"], "left_anti").selectExpr("concat('missing_', kind) as kind", "item", "0L as n")
    return c.unionByName(missing)


@query("a23_alignment_audit", f"with {FORMULAS}, w as (select candidate_id, count(*) as n, count(*) filter (where similarity >= 0.9) as hard, count(*) filter (where warning <> '') as warned from formulas group by candidate_id) select count(*) as rows_n, sum(n)::bigint as labels, sum(hard)::bigint as hard, round(sum(hard) / sum(n), 6) as hard_rate, count(*) filter (where hard = n) as fully_hard, sum(warned)::bigint as warned, sum(hard) / sum(n) >= 0.70 as passed from w")
def a23(spark, sf_dir):
    w = formulas(spark, sf_dir).groupBy("candidate_id").agg(F.count("*").alias("n"), F.expr("count_if(similarity >= 0.9)").alias("hard"), F.expr("count_if(warning <> '')").alias("warned"))
    return w.agg(F.count("*").alias("rows_n"), F.sum("n").alias("labels"), F.sum("hard").alias("hard"), F.expr("round(sum(hard) / sum(n), 6)").alias("hard_rate"), F.expr("count_if(hard = n)").alias("fully_hard"), F.sum("warned").alias("warned"), F.expr("sum(hard) / sum(n) >= 0.70").alias("passed"))


@query("a27_confusion", "with l as (select toxic as expected, case when doc_id % 7 = 0 then 1 - toxic else toxic end as predicted from labels), c as (select expected, predicted, count(*) as n from l group by all), s as (select *, sum(n) over (partition by expected)::bigint as support, sum(n) over (partition by predicted)::bigint as said from c) select expected, predicted, n, support, round(n / support, 6) as recall, round(n / said, 6) as precision from s")
def a27(spark, sf_dir):
    """A confusion table with recall and precision; the windows run over its few cells."""
    l = table(spark, sf_dir, "labels").selectExpr("toxic as expected", "if(doc_id % 7 = 0, 1 - toxic, toxic) as predicted")  # noqa: E741
    c = l.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    s = c.withColumn("support", F.expr("sum(n) over (partition by expected)")).withColumn("said", F.expr("sum(n) over (partition by predicted)"))
    return s.selectExpr("expected", "predicted", "n", "support", "round(n / support, 6) as recall", "round(n / said, 6) as precision")


@query("a28_class_weights", f"with {GLYPHS}, c as (select text as label, sum(size) as weight, count(*) as n from glyphs where text <> '' group by text) select label, n, weight, round(sqrt(sum(weight) over () / (count(*) over () * weight)), 6) as class_weight from c")
def a28(spark, sf_dir):
    """Weights that even out classes: the root of mean weight by own weight."""
    c = glyphs(spark, sf_dir).where("text <> ''").groupBy(F.col("text").alias("label")).agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    return c.selectExpr("label", "n", "weight", "round(sqrt(sum(weight) over () / (count(*) over () * weight)), 6) as class_weight")


@query("a29_feature_scale", f"with {GLYPHS} select font, round(avg(x0), 6) as mean_x0, round(greatest(stddev_pop(x0), 1e-6), 6) as scale_x0, round(avg(size), 6) as mean_size, round(greatest(stddev_pop(size), 1e-6), 6) as scale_size from glyphs group by font")
def a29(spark, sf_dir):
    g = glyphs(spark, sf_dir).groupBy("font")
    return g.agg(F.round(F.avg("x0"), 6).alias("mean_x0"), F.expr("round(greatest(stddev_pop(x0), 1e-6D), 6)").alias("scale_x0"), F.round(F.avg("size"), 6).alias("mean_size"), F.expr("round(greatest(stddev_pop(size), 1e-6D), 6)").alias("scale_size"))


@query("a36_keep_best", f"with {FORMULAS} select candidate_id, stage, max(score) as confidence, first(result_id order by score desc, result_id) as result_id from formulas group by all")
def a36(spark, sf_dir):
    return formulas(spark, sf_dir).groupBy("candidate_id", "stage").agg(F.max("score").alias("confidence"), F.expr("max_by(result_id, struct(score, -result_id))").alias("result_id"))


@query("a37_keep_first", f"with {BLOCKS} select {D.collapsed('content')} as content, min(doc_id) as first_doc, (first(n order by doc_id, n))::int as first_n from blocks where trim(content) <> '' group by 1")
def a37(spark, sf_dir):
    """Texts that differ in more than white space, each at its first place."""
    return blocks(spark, sf_dir).where("trim(content) <> ''").groupBy(F.expr(X.collapsed("content")).alias("content")).agg(F.min(F.struct("doc_id", "n")).alias("first")).select("content", F.col("first.doc_id").alias("first_doc"), F.col("first.n").alias("first_n"))


@query("a09_priority_wins", "with e as (select 'glyph' || (p_partkey % 40) as name, p_size as priority, p_brand as unicode, p_partkey as place from part), w as (select *, row_number() over (partition by name order by priority desc, place desc) as k from e) select name, unicode, priority, (select count(distinct unicode) from e x where x.name = w.name) > 1 as conflict from w where k = 1")
def a09(spark, sf_dir):
    """A name's entry of the highest priority, the later one on ties, and whether sources disagree."""
    e = table(spark, sf_dir, "part").selectExpr("concat('glyph', p_partkey % 40) as name", "p_size as priority", "p_brand as unicode", "p_partkey as place")
    g = e.groupBy("name").agg(F.expr("max_by(struct(unicode, priority), struct(priority, place))").alias("best"), F.countDistinct("unicode").alias("kinds"))
    return g.selectExpr("name", "best.unicode as unicode", "best.priority as priority", "kinds > 1 as conflict")


@query("a42_formulas_per_line", f"with {FORMULAS} select result_id, count(*) over (partition by page_num, stage) as per_line from formulas")
def a42(spark, sf_dir):
    return formulas(spark, sf_dir).selectExpr("result_id", "count(*) over (partition by page_num, stage) as per_line")


@query("a43_structure_labels", f"with {FORMULAS} select candidate_id, min(score) as confidence, case when count(*) = 0 then 'missing' when bool_and(score >= 0.5) then 'hard' else 'soft' end as supervision from formulas group by candidate_id")
def a43(spark, sf_dir):
    return formulas(spark, sf_dir).groupBy("candidate_id").agg(F.min("score").alias("confidence"), F.expr("case when count(*) = 0 then 'missing' when bool_and(score >= 0.5) then 'hard' else 'soft' end").alias("supervision"))


@query("a40_page_sets", f"with {BLOCKS} select doc_id, array_to_string(list_sort(list(distinct page_num)), ',') as pages from blocks where page_num >= 0 group by doc_id")
def a40(spark, sf_dir):
    return blocks(spark, sf_dir).where("page_num >= 0").groupBy("doc_id").agg(F.expr("array_join(array_sort(collect_set(page_num)), ',')").alias("pages"))


@query(
    "j09_row_joins",
    f"with {FORMULAS}, g as (select * from formulas where result_id % 5 <> 3), t as (select * from formulas where result_id % 4 <> 1) select coalesce(g.result_id, t.result_id) as row_id, case when t.result_id is null then 'target_row_missing' when g.result_id is null then 'graph_row_missing' else 'joined' end as status from g full join t on g.result_id = t.result_id",
)
def j09(spark, sf_dir):
    """Graph rows, target rows and alignments meet on the row's id; what is missing is told."""
    f = formulas(spark, sf_dir)
    g, t = f.where("result_id % 5 <> 3").selectExpr("result_id as row_id", "true as g"), f.where("result_id % 4 <> 1").selectExpr("result_id as row_id", "true as t")
    return g.join(t, "row_id", "full_outer").selectExpr("row_id", "case when t is null then 'target_row_missing' when g is null then 'graph_row_missing' else 'joined' end as status")


@query(
    "j20_glyph_names",
    "with g as (select p_partkey, case p_partkey % 5 when 0 then 'uni' || upper(printf('%04x', (945 + p_partkey % 20)::int)) when 1 then 'u' || upper(printf('%04x', (97 + p_partkey % 20)::int)) when 2 then 'alpha.alt' when 3 then 'beta' else 'nosuch' end as glyph_name from part), b as (select *, split_part(glyph_name, '.', 1) as base from g) select p_partkey, case when base = 'alpha' then 'α' when base = 'beta' then 'β' when regexp_full_match(base, 'uni[0-9A-Fa-f]{4}') then chr(('0x' || substr(base, 4))::int) when regexp_full_match(base, 'u[0-9A-Fa-f]{4,6}') then chr(('0x' || substr(base, 2))::int) else '' end as unicode from b",
)
def j20(spark, sf_dir):
    """A glyph name's character: by table, else by the code point that the name spells."""
    name = "case p_partkey % 5 when 0 then concat('uni', upper(lpad(lower(hex(945 + p_partkey % 20)), 4, '0'))) when 1 then concat('u', upper(lpad(lower(hex(97 + p_partkey % 20)), 4, '0'))) when 2 then 'alpha.alt' when 3 then 'beta' else 'nosuch' end"
    known = F.broadcast(spark.createDataFrame([("alpha", "α"), ("beta", "β")], "base string, listed string"))
    g = table(spark, sf_dir, "part").selectExpr("p_partkey", f"split_part({name}, '.', 1) as base").join(known, "base", "left")
    code = lambda skip: f"cast(conv(substring(base, {skip}), 16, 10) as int)"
    wide = lambda c: f"concat(lpad(hex(55296 + ({c} - 65536) div 1024), 4, '0'), lpad(hex(56320 + ({c} - 65536) % 1024), 4, '0'))"
    spelled = lambda skip: f"decode(unhex(if({code(skip)} < 65536, lpad(hex({code(skip)}), 4, '0'), {wide(code(skip))})), 'utf-16be')"
    return g.selectExpr("p_partkey", f"case when listed is not null then listed when base rlike '^uni[0-9A-Fa-f]{{4}}$' then {spelled(4)} when base rlike '^u[0-9A-Fa-f]{{4,6}}$' then {spelled(2)} else '' end as unicode")


_TERMS = "terms as (select n_nationkey as place, case when n_nationkey % 2 = 0 then 'math' else 'cs_ml' end as domain, case when n_nationkey % 4 = 3 then 'Kernel' else n_name end as en, 'zh' || n_nationkey as zh, n_nationkey % 8 = 7 as force, case when n_nationkey % 5 = 0 then ['Alias' || (n_nationkey % 10)] else []::varchar[] end as aliases from nation)"


def glossary(spark, sf_dir):
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey as place", "if(n_nationkey % 2 = 0, 'math', 'cs_ml') as domain", "if(n_nationkey % 4 = 3, 'Kernel', n_name) as en", "concat('zh', n_nationkey) as zh", "n_nationkey % 8 = 7 as force", "if(n_nationkey % 5 = 0, array(concat('Alias', n_nationkey % 10)), array()) as aliases")


_MAPPING = f"{_TERMS}, k as (select unnest(list_concat([en], aliases)) as k, zh, force, (domain = 'cs_ml')::int as d, place from terms), m as (select lower(k) as key, zh, row_number() over (partition by lower(k) order by force desc, case when force then -d else d end, case when force then -place else place end) as r from k)"


@query("j29_glossary", f"with {_MAPPING} select key, zh from m where r = 1")
def j29(spark, sf_dir):
    """One translation for each term and alias: the last forced one, else the first in order of domains."""
    k = glossary(spark, sf_dir).selectExpr("explode(concat(array(en), aliases)) as k", "zh", "force", "cast(domain = 'cs_ml' as int) as d", "place")
    return k.groupBy(F.expr("lower(k)").alias("key")).agg(F.expr("coalesce(max_by(if(force, zh, null), if(force, struct(d, place), null)), min_by(zh, struct(d, place)))").alias("zh"))


@query("f31_glossary_prompt", f"with {_MAPPING} select string_agg('- ' || key || ' -> ' || zh, chr(10) order by key) as prompt from m where r = 1")
def f31(spark, sf_dir):
    return j29(spark, sf_dir).agg(F.expr("array_join(transform(array_sort(collect_list(struct(key, zh))), s -> concat('- ', s.key, ' -> ', s.zh)), '\\n')").alias("prompt"))


@query("f32_glossary_search", f"with {_TERMS} select domain, en, zh from terms where contains(lower(en), 'nat') or contains(zh, '2')")
def f32(spark, sf_dir):
    return glossary(spark, sf_dir).where("contains(lower(en), 'nat') or contains(zh, '2')").select("domain", "en", "zh")


@query(
    "j24_effective_pages",
    f"with {BLOCKS}, t as (select doc_id, n, case when block_type = 'heading' then page_num end as toc_page from blocks), f as (select *, last_value(toc_page ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row) as page from t), m as (select doc_id, page, min(page) over (partition by doc_id order by page range between 1 following and unbounded following) as next_page from (select distinct doc_id, page from f where page is not null)) select f.doc_id, f.n, f.page, least(greatest(coalesce(m.next_page - 1, 6), f.page), greatest(6, f.page)) as end_page from f left join m on f.doc_id = m.doc_id and f.page = m.page",
)
def j24(spark, sf_dir):
    """Entries take the page of the last titled one before them, and end before the next larger page."""
    t = blocks(spark, sf_dir).selectExpr("doc_id", "n", "case when block_type = 'heading' then page_num end as toc_page")
    f = t.withColumn("page", F.expr("last(toc_page, true) over (partition by doc_id order by n rows unbounded preceding)")).drop("toc_page")
    m = f.where("page is not null").select("doc_id", "page").distinct().withColumn("next_page", F.expr("lead(page) over (partition by doc_id order by page)"))
    return f.join(m, ["doc_id", "page"], "left").selectExpr("doc_id", "n", "page", "least(greatest(coalesce(next_page - 1, 6), page), greatest(6, page)) as end_page")


@query("s21_document_ids", "select doc_id, left(sha256(text), 16) as hash from documents where text is not null")
def s21(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "left(sha2(text, 256), 16) as hash")


@query("j34_document_alignment", "with h as (select doc_id, length(text) as n, sha256(left(text, 200)) as head, sha256(text) as whole from documents where text is not null) select a.doc_id, b.doc_id as other, case when a.whole = b.whole then 'identical' when a.n = b.n then 'same_size' else 'same_head' end as status from h a join h b on a.head = b.head and a.doc_id < b.doc_id where a.doc_id = (select min(doc_id) from h m where m.head = a.head)")
def j34(spark, sf_dir):
    """Documents with one beginning against the first of them: identical, as long, or only alike at the head."""
    h = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "length(text) as n", "sha2(left(text, 200), 256) as head", "sha2(text, 256) as whole")
    first = h.groupBy("head").agg(F.expr("min_by(struct(doc_id, n, whole), doc_id)").alias("a"))
    return h.join(first, "head").where("doc_id > a.doc_id").selectExpr("a.doc_id as doc_id", "doc_id as other", "case when a.whole = whole then 'identical' when a.n = n then 'same_size' else 'same_head' end as status")
