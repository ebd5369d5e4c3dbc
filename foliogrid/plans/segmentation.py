"""Display seeds and confidence, roles of rules, scoped matching, candidate evidence and other scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions import geometry as G
from foliogrid.functions import symbols
from foliogrid.functions import text as X
from foliogrid.operators import decode, matching
from foliogrid.plans import duck as D
from foliogrid.plans.base import BLOCKS, FORMULAS, GLYPHS, blocks, formulas, glyphs, query
from foliogrid.operators.pairs import local_pairs
from foliogrid.plans.glyphs import _EDGES, relation_edges
from foliogrid.session import cut, table

#: Densities and shares of width that make a line a display seed.
LEAST_DENSITY, STRONG_DENSITY, FULL_WIDTH, SEED = 0.12, 0.32, 0.86, 0.72
PAGE, BODY_LEFT, BODY_WIDTH = 120.0, 10.0, 100.0

_LINE_COLUMNS = "math / n as density, x1 - x0 as width"
_CENTRED = f"abs((x0 + x1) / 2 - {BODY_LEFT + BODY_WIDTH / 2}) <= {BODY_WIDTH * 0.13}"
_POSITION = f"({_CENTRED} or (width <= {BODY_WIDTH * SEED} and greatest(x0 - {BODY_LEFT}, 0) >= {BODY_WIDTH * 0.06} and greatest({BODY_LEFT + BODY_WIDTH} - x1, 0) >= {BODY_WIDTH * 0.06}))"
_SEED = f"""case when n = 0 or width > {PAGE * FULL_WIDTH} or not (math_font or symbol or script or unknown) then false
  when density >= {STRONG_DENSITY} and {_POSITION} then not (width < {BODY_WIDTH * 0.08} and not ({_CENTRED})) and width <= {BODY_WIDTH * SEED}
  when {_CENTRED} and width <= {BODY_WIDTH * SEED} and density >= {LEAST_DENSITY} then {_POSITION} and width >= {BODY_WIDTH * 0.10} else false end"""
_CONFIDENCE = f"round(least(1.0, case when math_font then 0.24 else 0.0 end + case when symbol then 0.16 else 0.0 end + case when script then 0.12 else 0.0 end + case when density >= {LEAST_DENSITY} then 0.16 else 0.0 end + case when {_CENTRED} then 0.08 else 0.0 end + case when width <= {BODY_WIDTH * SEED} then 0.05 else 0.0 end + case when n > 4 then 0.06 else 0.0 end), 3)"

_LINES = """l0 as (select page_num, count(*) as n, min(x0) as x0, max(x1) as x1, count(*) filter (where regexp_matches(font, 'CM|Symbol')) as math, bool_or(regexp_matches(font, 'CM|Symbol')) as math_font, bool_or(regexp_matches(text, '[=+-]')) as symbol, min(size) < 0.84 * max(size) as script, bool_or(text in ('', '\ufffd') or left(text, 4) = 'cid:') as unknown from glyphs group by page_num), l as (select *, """ + _LINE_COLUMNS + """ from l0)"""


def lines(spark, sf_dir):
    """A page's glyphs as one line, with its evidence."""
    out = glyphs(spark, sf_dir).groupBy("page_num").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.expr("count_if(font rlike 'CM|Symbol')").alias("math"), F.expr("bool_or(font rlike 'CM|Symbol')").alias("math_font"), F.expr("bool_or(text rlike '[=+-]')").alias("symbol"), F.expr("min(size) < 0.84 * max(size)").alias("script"), F.expr("bool_or(text in ('', '\ufffd') or left(text, 4) = 'cid:')").alias("unknown"))
    return out.selectExpr("*", "math / n as density", "x1 - x0 as width")


@query("p26_display_seeds", f"with {GLYPHS}, {_LINES} select page_num, {_SEED} as seed from l")
def p26(spark, sf_dir):
    return lines(spark, sf_dir).selectExpr("page_num", f"{_SEED} as seed")


@query("g11_display_confidence", f"with {GLYPHS}, {_LINES} select page_num, {_CONFIDENCE}::double as confidence from l")
def g11(spark, sf_dir):
    return lines(spark, sf_dir).selectExpr("page_num", f"cast({_CONFIDENCE} as double) as confidence")


LEAST_ROLE, LEAST_ENCLOSURE = 0.45, 0.35
_ROLES = G.role_scores("v_", "b_", "c_")
_LEASTS = {role: LEAST_ENCLOSURE if role == "enclosure" else LEAST_ROLE for role in _ROLES}
_V = "b_x0 + i * 3 as v_x0, b_y0 - 2 + i * 4 as v_y0, case when i = 2 then b_x0 + 7 else b_x1 - i end as v_x1, case when i = 2 then b_y1 + 9 else b_y0 - 1 + i * 4 end as v_y1, b_x0 + 2 as c_x0, b_y1 + 3 as c_y0, b_x1 - 1 as c_x1, b_y1 + 11 as c_y1"


@query(
    "j32_rule_roles",
    f"""with {GLYPHS}, b as (select page_num, min(x0) as b_x0, min(y0) as b_y0, max(x1) as b_x1, max(y1) as b_y1 from glyphs group by page_num),
    v as (select *, {_V} from b, (values (0), (1), (2)) t(i)), s as ({' union all '.join(f"select page_num, '{r}' as role, i, round(({e})::double, 6) as score from v" for r, e in _ROLES.items())}),
    k as (select *, row_number() over (partition by page_num, role order by score desc, i) as place from s) select page_num, role, i as rule, score from k where place = 1 and score >= case role when 'enclosure' then {LEAST_ENCLOSURE} else {LEAST_ROLE} end""",
)
def j32(spark, sf_dir):
    """The mark that serves a body best in each role (G10): as a fraction's bar, over or under it, as a root's, a frame, a fence, a border."""
    b = glyphs(spark, sf_dir).groupBy("page_num").agg(F.min("x0").alias("b_x0"), F.min("y0").alias("b_y0"), F.max("x1").alias("b_x1"), F.max("y1").alias("b_y1"))
    v = b.selectExpr("*", "explode(array(0, 1, 2)) as i").selectExpr("*", *_V.split(", "))
    roles = ", ".join(f"struct('{r}' as role, round(cast({e} as double), 6) as score, {_LEASTS[r]}D as least)" for r, e in _ROLES.items())
    return v.selectExpr("page_num", "i", f"inline(array({roles}))").groupBy("page_num", "role").agg(F.expr("max_by(i, struct(score, -i))").alias("rule"), F.max("score").alias("score"), F.max("least").alias("least")).where("score >= least").drop("least")


@query(
    "j22_scoped_blocking",
    f"""with {FORMULAS}, n as (select result_id as id, {D.formula_normal('latex')} as normal, stage, page_num, page_num + result_id % 3 as last_page from formulas), tok as (select id, normal, stage, page_num, last_page, unnest({D.match_tokens('normal')}) as token from n),
    p as (select l.id as left_id, r.id as right_id, any_value(l.page_num) as page, any_value(r.page_num) as a, any_value(r.last_page) as z, any_value(length(l.normal)) as ln, any_value(length(r.normal)) as rn, count(*) as shared from tok l join tok r using (token) where l.stage = 'local_precise' and r.stage = 'parsed_blocks' group by l.id, r.id),
    k as (select *, case when page between a and z then 0 when page between a - 2 and z + 2 then 1 else 2 end as tier from p), o as (select *, row_number() over (partition by left_id order by tier, shared desc, abs(rn - ln), right_id) as place from k)
    select left_id, right_id, tier::int as tier, place::int as place from o where place <= 5""",
)
def j22(spark, sf_dir):
    """Blocked partners scoped by page: the page's own first, then two pages round it, then the rest."""
    n = formulas(spark, sf_dir).selectExpr("result_id as id", f"{X.formula_normal('latex')} as normal", "stage", "page_num", "page_num + result_id % 3 as last_page")
    a = n.where("stage = 'local_precise'").selectExpr("id", "normal", "page_num as page")
    b = n.where("stage = 'parsed_blocks'").selectExpr("id", "normal", "page_num as first_page", "last_page")
    return scoped_blocking(a, b)


def scoped_blocking(left: DataFrame, right: DataFrame, limit: int = 5) -> DataFrame:
    """(left_id, right_id, tier, place): the ``limit`` best partners by tier, shared tokens, length and id, from (id, normal, page) and (id, normal, first_page, last_page).

    Equal forms on a page have equal partners, so different forms meet on their tokens; of a form's ids in a tier of a page the first ``limit`` can count.
    Pages meet spans of pages as different values, of which there are few.
    """
    forms = lambda df, k: cut(df.select("normal").distinct().withColumn(k, F.monotonically_increasing_id()))
    lf, rf = forms(left, "l"), forms(right, "r")
    tokens = lambda df, k: df.selectExpr(k, f"length(normal) as {k}n", f"explode({X.match_tokens('normal')}) as token")
    pairs = tokens(lf, "l").join(tokens(rf, "r"), "token").groupBy("l", "r", "ln", "rn").agg(F.count("*").alias("shared")).selectExpr("l", "r", "shared", "abs(rn - ln) as off")
    own = cut(left.join(lf, "normal").select("id", "l", "page").distinct())
    # a row that comes again shares its tokens again
    others = right.groupBy("id", "normal", "first_page", "last_page").agg(F.count("*").alias("copies")).join(rf, "normal")
    spans = ["r", "first_page", "last_page", "copies"]
    others = cut(others.withColumn("k", F.expr(f"row_number() over (partition by {', '.join(spans)} order by id)")).where(F.col("k") <= limit).select("id", *spans))
    tier = F.expr("case when page between first_page and last_page then 0 when page between first_page - 2 and last_page + 2 then 1 else 2 end")
    tiers = own.select("page").distinct().crossJoin(others.select("first_page", "last_page").distinct()).withColumn("tier", tier)
    met = others.join(tiers, ["first_page", "last_page"]).withColumn("k", F.expr("row_number() over (partition by r, page, tier, copies order by id)"))
    met = cut(met.where(F.col("k") <= limit).selectExpr("r", "page", "tier", "copies", "id as right_id"))
    # a form counts in a tier of a page if fewer than `limit` are better
    near = pairs.join(met.select("r", "page", "tier", "copies").distinct(), "r").join(own.select("l", "page").distinct(), ["l", "page"], "left_semi").withColumn("shared", F.col("shared") * F.col("copies"))
    near = near.withColumn("better", F.expr("rank() over (partition by l, page order by tier, shared desc, off)")).where(F.col("better") <= limit)
    best = near.join(met, ["r", "page", "tier", "copies"]).withColumn("place", F.expr("row_number() over (partition by l, page order by tier, shared desc, off, right_id)")).where(F.col("place") <= limit).drop("place")
    place = "row_number() over (partition by left_id order by tier, shared desc, off, right_id)"  # an id may have several forms
    return own.withColumnRenamed("id", "left_id").join(best, ["l", "page"]).withColumn("place", F.expr(place)).where(F.col("place") <= limit).select("left_id", "right_id", "tier", "place")


@query("j26_markdown_paragraphs")
def j26(spark, sf_dir):
    """The paragraph of a document's clean text that is most like each block, where one is like it by more than 0.6.

    Pages' last lines are followed by a blank one in the clean text here, and hyphens at line ends are closed up, so that paragraphs differ from blocks.
    """
    b = blocks(spark, sf_dir).where("block_type <> 'image'").selectExpr("doc_id", "block_id", "content")
    marked = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "array_join(transform(split(text, '\\n'), (x, i) -> if(i % 10 = 9, concat(replace(x, '-', ''), '\\n'), concat(x, '\\n'))), '\\n') as text")
    return matching.paragraphs_of_blocks(b, marked)


@query("p34_candidate_evidence", f"with {GLYPHS}, {_EDGES}, h as (select page_num, count(*) as edges, count(*) filter (where hint in ('superscript_zone', 'subscript_zone', 'above_zone', 'below_zone')) as structural from e group by page_num), g as (select page_num, count(*) as n, count(*) filter (where {X.unknown_glyph('text')}) as unknown from glyphs group by page_num) select g.page_num, coalesce(edges, 0) as edges, round(coalesce(edges, 0) / n, 6) as density, coalesce(structural, 0) > 0 as structural_signal, round(unknown / n, 6) as unknown_rate from g left join h using (page_num)")
def p34(spark, sf_dir):
    """Evidence of a candidate: edges, their density, structural hints and unknown glyphs."""
    g = glyphs(spark, sf_dir)
    h = relation_edges(g).groupBy(F.col("s_page_num").alias("page_num")).agg(F.count("*").alias("edges"), F.expr("count_if(hint in ('superscript_zone', 'subscript_zone', 'above_zone', 'below_zone'))").alias("structural"))
    n = g.groupBy("page_num").agg(F.count("*").alias("n"), F.expr(f"count_if({X.unknown_glyph('text')})").alias("unknown"))
    return n.join(h, "page_num", "left").selectExpr("page_num", "coalesce(edges, 0) as edges", "round(coalesce(edges, 0) / n, 6) as density", "coalesce(structural, 0) > 0 as structural_signal", "round(unknown / n, 6) as unknown_rate")


def taught(relation: str) -> str:
    """Whether a parser is taught a relation; both dialects read it."""
    return f"({relation} in ({', '.join(repr(r) for r in decode.RELATIONS if r != 'NONE' and r not in decode.UNTAUGHT)}))"


_NAMES = "['" + "', '".join([*decode.RELATIONS, "HORIZONTAL"]) + "']"


@query("p27_training_relations", f"with r as (select l_returnflag as split, {_NAMES}[(l_partkey % {len(decode.RELATIONS) + 1} + 1)::int] as relation from lineitem) select split, relation, count(*) as n from r where {taught('relation')} group by all")
def p27(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as split", f"element_at(array{_NAMES.replace('[', '(').replace(']', ')')}, cast(l_partkey % {len(decode.RELATIONS) + 1} + 1 as int)) as relation")
    return r.where(taught("relation")).groupBy("split", "relation").agg(F.count("*").alias("n"))


@query("t11_batch_budgets", f"with {BLOCKS}, d as (select doc_id, max(page_num) + 1 as pages from blocks group by doc_id), t as (select * from (values ('viewport', 2), ('evidence', 4), ('user_action', 6), ('background', 8)) v(trigger, budget)) select doc_id, trigger, (case when trigger = 'background' and pages >= 3 then greatest(1, budget // 2) else budget end)::int as budget from d, t")
def t11(spark, sf_dir):
    """Work budgets by trigger; background work is halved for long documents."""
    d = blocks(spark, sf_dir).groupBy("doc_id").agg((F.max("page_num") + 1).alias("pages"))
    t = d.selectExpr("doc_id", "pages", "inline(array(struct('viewport' as trigger, 2 as budget), struct('evidence' as trigger, 4 as budget), struct('user_action' as trigger, 6 as budget), struct('background' as trigger, 8 as budget)))")
    return t.selectExpr("doc_id", "trigger", "cast(if(trigger = 'background' and pages >= 3, greatest(1, budget div 2), budget) as int) as budget")


_EVERY = "".join(symbols.SPELLED)


@query(
    "f22_unicode_to_latex",
    f"""with s as (select item_id, 'α_' || left(text, 12) || '∑ × 5% & β' || {D.q(_EVERY)}[(item_id % 7 + 1)::int:] as raw from benchmark), c as (select item_id, unnest(string_split(raw, '')) as c, generate_subscripts(string_split(raw, ''), 1) as i from s), t as (select * from (values {', '.join(f"({D.q(k)}, {D.q(v)})" for k, v in symbols.SPELLED.items())}) v(k, spelled))
    select item_id, string_agg(coalesce(spelled, c), '' order by i) as latex from c left join t on c = k group by item_id""",
)
def f22(spark, sf_dir):
    """Characters as LaTeX, one by one, by the tables; each text ends with nearly all of these."""
    s = table(spark, sf_dir, "benchmark").selectExpr("item_id", f"concat('α_', left(text, 12), '∑ × 5% & β', substr({X.literal(_EVERY)}, item_id % 7 + 1)) as raw")
    return s.selectExpr("item_id", f"{symbols.spelled('raw')} as latex")


_REPLY = "case item_id % 3 when 0 then '1. what is ' || item_id || '?' || chr(10) || '- why' || chr(10) || '- why' || chr(10) || chr(10) || '* how' when 1 then 'Questions: [\"a  b\", \"c\", \"a  b\", \"d\", \"e\"]' else '' end"


@query(
    "f34_follow_ups",
    rf"with r as (select item_id, {_REPLY} as reply from benchmark), p as (select item_id, case when contains(reply, '[') then regexp_extract_all(regexp_extract(reply, '(\[.*\])', 1), '\"([^\"]*)\"', 1) else string_split(reply, chr(10)) end as parts from r), c as (select item_id, i, left(trim(regexp_replace({D.collapsed('parts[i]')}, '^[-*•0-9.、)）\s]+', '')), 160) as value from p, unnest(range(1, len(parts) + 1)) u(i)), f as (select item_id, value, min(i) as i from c where value <> '' group by all), k as (select *, row_number() over (partition by item_id order by i) as place from f) select item_id, string_agg(value, '|' order by i) as questions from k where place <= 3 group by item_id",
)
def f34(spark, sf_dir):
    """Follow-up questions of a reply: a JSON list, else its lines, without bullets, each once, three at most."""
    reply = "case item_id % 3 when 0 then concat('1. what is ', item_id, '?\\n- why\\n- why\\n\\n* how') when 1 then 'Questions: [\"a  b\", \"c\", \"a  b\", \"d\", \"e\"]' else '' end"
    r = table(spark, sf_dir, "benchmark").selectExpr("item_id", f"{reply} as reply")
    r = r.selectExpr("item_id", "if(contains(reply, '['), from_json(regexp_extract(reply, '(\\\\[.*\\\\])', 1), 'array<string>'), split(reply, '\\n')) as parts")
    bare = f"left(trim({X.regex_replace(X.collapsed('p'), r'^[-*•0-9.、)）\s]+')}), 160)"
    out = r.selectExpr("item_id", f"slice(array_distinct(filter(transform(parts, p -> {bare}), v -> v <> '')), 1, 3) as q")
    return out.where("size(q) > 0").selectExpr("item_id", "array_join(q, '|') as questions")


@query("g13_softmax", f"with {FORMULAS}, m as (select candidate_id, result_id, least(greatest(score * 10, -80), 80) as z from formulas), s as (select *, exp(z - max(z) over (partition by candidate_id)) as e from m) select result_id, round(e / sum(e) over (partition by candidate_id), 6) as share, round(1 / (1 + exp(-z)), 6) as sigmoid from s")
def g13(spark, sf_dir):
    """Scores of a group as shares and on their own as probabilities, clamped at 80."""
    m = formulas(spark, sf_dir).selectExpr("candidate_id", "result_id", "least(greatest(score * 10, -80), 80) as z").selectExpr("*", "exp(z - max(z) over (partition by candidate_id)) as e")
    return m.selectExpr("result_id", "round(e / sum(e) over (partition by candidate_id), 6) as share", "round(1 / (1 + exp(-z)), 6) as sigmoid")


@query("d06_bookmarks_reorder", "with b as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as place from events where event_type = 'click'), m as (select *, case when place = 1 then 2.5 else place end as wanted from b where event_id % 13 <> 0) select user_id, event_id, row_number() over (partition by user_id order by wanted, event_id)::int as place from m")
def d06(spark, sf_dir):
    """Bookmarks with some removed and the first one moved behind the second."""
    b = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("user_id", "event_id", "row_number() over (partition by user_id order by event_id) as place").where("event_id % 13 <> 0")
    return b.selectExpr("user_id", "event_id", "row_number() over (partition by user_id order by if(place = 1, 2.5, place), event_id) as place")


@query("p23_backend_skips", "with c as (select c_custkey, case c_custkey % 4 when 0 then '' when 1 then ' Mock ' else c_mktsegment end as model, c_acctbal >= 0 as available from customer), t as (select *, trim(model) as m from c) select c_custkey, case when m = '' then 'semantic_review_backend_unavailable:empty_model' when lower(m) = 'mock' then 'semantic_review_backend_unavailable:mock_model=' || m when not available then 'semantic_review_backend_unavailable:model=' || m else '' end as reason from t")
def p23(spark, sf_dir):
    """Why a backend is passed over: no model, a stand-in, or not there; a customer stands for one."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "case c_custkey % 4 when 0 then '' when 1 then ' Mock ' else c_mktsegment end as model", "c_acctbal >= 0 as available")
    return c.selectExpr("c_custkey", f"{X.backend_skip('model', 'available')} as reason")


@query("g06_radical_bodies", f"with {GLYPHS}, r as (select s.node_id as source, t.node_id as target, t.x0 - s.x1 as gap, greatest(s.y1 - s.y0, t.y1 - t.y0, 1) as h, {G.span_overlap('s.', 't.', 'y')} as rise, abs((t.y0 + t.y1) / 2 - (s.y0 + s.y1) / 2) as dy from glyphs s join glyphs t on s.page_num = t.page_num where s.text = '+' and s.node_id <> t.node_id and (t.x0 + t.x1) / 2 > (s.x0 + s.x1) / 2) select source, target from r where gap <= 4 * h and (rise >= 0.05 or dy <= 1.6 * h)")
def g06(spark, sf_dir):
    """What may stand under a radical (a plus stands for one here): to its right, near and about level."""
    p = local_pairs(glyphs(spark, sf_dir)).where("s_text = '+' and (t_x0 + t_x1) / 2 > (s_x0 + s_x1) / 2")
    p = p.selectExpr("s_node_id as source", "t_node_id as target", "t_x0 - s_x1 as gap", "greatest(s_y1 - s_y0, t_y1 - t_y0, 1) as h", f"{G.span_overlap('s_', 't_', 'y')} as rise", "abs((t_y0 + t_y1) / 2 - (s_y0 + s_y1) / 2) as dy")
    return p.where("gap <= 4 * h and (rise >= 0.05 or dy <= 1.6 * h)").select("source", "target")
