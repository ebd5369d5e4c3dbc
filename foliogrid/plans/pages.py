"""Page layout: body margins, display lines, rules, regions and their diagnostics, chains and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.functions import geometry as G
from foliogrid.functions import text as X
from foliogrid.plans.base import BLOCKS, FORMULAS, GLYPHS, blocks, formulas, glyphs, query

WIDTH = 600.0
#: Tolerances of display lines, as shares of the body's width.
CENTRED, SEED_WIDTH, INDENT = 0.13, 0.72, 0.06

_LABEL = r"^\([0-9.-]{1,6}\)$"


def _layout(duck: bool) -> str:
    """Upper medians of body lines by page, with the default margins where there is none."""
    body = f"length(content) >= 20 and x1 - x0 >= {WIDTH * 0.35}"
    left, right = ("(list_sort(list(x0) filter (where {0})))[count(*) filter (where {0}) // 2 + 1]", "(list_sort(list(x1) filter (where {0})))[count(*) filter (where {0}) // 2 + 1]") if duck else ("get(sort_array(collect_list(if({0}, x0, null))), cast(floor(count_if({0}) / 2) as int))", "get(sort_array(collect_list(if({0}, x1, null))), cast(floor(count_if({0}) / 2) as int))")
    return f"coalesce({left.format(body)}, {WIDTH * 0.08}) as body_left, coalesce({right.format(body)}, {WIDTH * 0.92}) as body_right"


_CENTRE = f"abs((x0 + x1) / 2 - (body_left + body_right) / 2) <= (body_right - body_left) * {CENTRED}"
_SHORT = f"(x1 - x0 <= (body_right - body_left) * {SEED_WIDTH} or (x0 >= body_left + (body_right - body_left) * {INDENT} and x1 <= body_right - (body_right - body_left) * {INDENT}))"
_PLACE = f"({_CENTRE} or (x1 - x0 <= (body_right - body_left) * {SEED_WIDTH} and greatest(x0 - body_left, 0) >= (body_right - body_left) * {INDENT} and greatest(body_right - x1, 0) >= (body_right - body_left) * {INDENT}))"


@query("w20_page_body", f"with {BLOCKS} select doc_id, page_num, {_layout(True)} from blocks group by all")
def w20(spark, sf_dir):
    a, b = _layout(False).split(" as body_left, ")
    return blocks(spark, sf_dir).groupBy("doc_id", "page_num").agg(F.expr(a).alias("body_left"), F.expr(b.removesuffix(" as body_right")).alias("body_right"))


@query("p33_display_lines", f"with {BLOCKS}, m as (select doc_id, page_num, {_layout(True)} from blocks group by all) select doc_id, block_id, {_CENTRE} as centred, {_SHORT} as is_short, {_PLACE} as display_position, regexp_matches(trim(content), '{_LABEL}') and x0 >= {WIDTH * 0.68} as equation_label, regexp_full_match(trim(content), '[*∗†‡§]{{1,3}}') as footnote_marker from blocks join m using (doc_id, page_num)")
def p33(spark, sf_dir):
    """Lines that may be displayed: centred, short or indented; labels and footnote marks."""
    out = blocks(spark, sf_dir).join(w20(spark, sf_dir), ["doc_id", "page_num"])
    return out.selectExpr("doc_id", "block_id", f"{_CENTRE} as centred", f"{_SHORT} as is_short", f"{_PLACE} as display_position", f"trim(content) rlike {X.literal(_LABEL)} and x0 >= {WIDTH * 0.68} as equation_label", "trim(content) rlike '^[*∗†‡§]{1,3}$' as footnote_marker")


_OPS = "=+-*/^_()[]{}|<>√∈∑∫"


@query(
    "a14_region_diagnostics",
    rf"""with {GLYPHS}, g as (select *, regexp_matches(font, 'CM|Symbol') as math_font, regexp_full_match(text, '\p{{L}}') as letter, regexp_full_match(text, '[0-9]') as digit, text <> '' and contains('{_OPS}', text) as operator, (text in ('', chr(65533)) or left(text, 4) = 'cid:') as unknown from glyphs),
    c as (select page_num, count(*) as n, count(*) filter (where math_font or operator) as math, count(*) filter (where letter and font like '%Times%') as roman, count(*) filter (where operator) as operators, count(*) filter (where digit) as digits, bool_or(unknown) as unknown from g group by page_num)
    select page_num, n as glyphs, math as math_glyphs, round(math / n, 3) as density, roman, operators, digits, unknown, case when roman >= 18 and math / n < 0.45 then 'review' when math / n >= 0.55 or operators >= 2 then 'formula_candidate' else 'review' end as class from c""",
)
def a14(spark, sf_dir):
    """Counts of a region's glyphs and what they make it."""
    g = glyphs(spark, sf_dir).selectExpr("page_num", "font rlike 'CM|Symbol' as math_font", "text rlike '^\\\\p{L}$' as letter", "text rlike '^[0-9]$' as digit", f"text <> '' and contains({X.literal(_OPS)}, text) as operator", "text in ('', '\ufffd') or left(text, 4) = 'cid:' as unknown", "contains(font, 'Times') as times")
    c = g.groupBy("page_num").agg(F.count("*").alias("n"), F.expr("count_if(math_font or operator)").alias("math"), F.expr("count_if(letter and times)").alias("roman"), F.expr("count_if(operator)").alias("operators"), F.expr("count_if(digit)").alias("digits"), F.expr("bool_or(unknown)").alias("unknown"))
    return c.selectExpr("page_num", "n as glyphs", "math as math_glyphs", "round(math / n, 3) as density", "roman", "operators", "digits", "unknown", "case when roman >= 18 and math / n < 0.45 then 'review' when math / n >= 0.55 or operators >= 2 then 'formula_candidate' else 'review' end as class")


_RULE = "select page_num, 'v' || page_num as rule_id, min(x0)::double as rx0, (102 + page_num % 7)::double as ry0, (min(x0) + 40)::double as rx1, (103 + page_num % 7)::double as ry1 from glyphs group by page_num"


@query(
    "j18_rule_neighbours",
    f"""with {GLYPHS}, r as ({_RULE}), p as (select r.page_num, rule_id, node_id, case when (y0 + y1) / 2 < (ry0 + ry1) / 2 then 'above_rule_candidate' when (y0 + y1) / 2 > (ry0 + ry1) / 2 then 'below_rule_candidate' end as hint, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy
      from r join glyphs g on r.page_num = g.page_num where {G.span_overlap('r.r', 'g.', 'x').replace('r.rx', 'r.rx')} >= 0.05),
    k as (select *, row_number() over (partition by rule_id, hint order by cx, cy, node_id) as place from p where hint is not null) select rule_id, node_id, hint, place::int as place from k where place <= 24""",
)
def j18(spark, sf_dir):
    """Glyphs above and below the rules of their page, 24 on a side at most."""
    g = glyphs(spark, sf_dir)
    r = g.groupBy("page_num").agg(F.min("x0").alias("rx0")).selectExpr("page_num", "concat('v', page_num) as rule_id", "rx0", "cast(102 + page_num % 7 as double) as ry0", "rx0 + 40 as rx1", "cast(103 + page_num % 7 as double) as ry1")
    p = r.join(g, "page_num").where(f"{G.span_overlap('r', '', 'x')} >= 0.05").selectExpr("rule_id", "node_id", "case when (y0 + y1) / 2 < (ry0 + ry1) / 2 then 'above_rule_candidate' when (y0 + y1) / 2 > (ry0 + ry1) / 2 then 'below_rule_candidate' end as hint", "(x0 + x1) / 2 as cx", "(y0 + y1) / 2 as cy").where("hint is not null")
    return p.withColumn("place", F.expr("row_number() over (partition by rule_id, hint order by cx, cy, node_id)")).where("place <= 24").select("rule_id", "node_id", "hint", "place")


@query("p32_fraction_bars", f"with {GLYPHS}, r as ({_RULE}), s as (select rule_id, count(*) filter (where (y0 + y1) / 2 < ry0 + 0.8) as above, count(*) filter (where (y0 + y1) / 2 > ry1 - 0.8) as below from r join glyphs g on r.page_num = g.page_num and g.x0 < r.rx1 and r.rx0 < g.x1 group by rule_id) select rule_id, above, below, case when above > 0 and below > 0 then 'fraction_bar' when above > 0 then 'overline' else 'none' end as kind from s")
def p32(spark, sf_dir):
    g = glyphs(spark, sf_dir)
    r = g.groupBy("page_num").agg(F.min("x0").alias("rx0")).selectExpr("page_num", "concat('v', page_num) as rule_id", "rx0", "cast(102 + page_num % 7 as double) as ry0", "rx0 + 40 as rx1", "cast(103 + page_num % 7 as double) as ry1")
    s = r.join(g, "page_num").where("x0 < rx1 and rx0 < x1").groupBy("rule_id").agg(F.expr("count_if((y0 + y1) / 2 < ry0 + 0.8)").alias("above"), F.expr("count_if((y0 + y1) / 2 > ry1 - 0.8)").alias("below"))
    return s.selectExpr("rule_id", "above", "below", "case when above > 0 and below > 0 then 'fraction_bar' when above > 0 then 'overline' else 'none' end as kind")


@query("t14_tag_anchors", f"with {GLYPHS}, t as (select page_num, arg_max(node_id, idx) as tag, arg_max(x0, idx) as tx, arg_max((y0 + y1) / 2, idx) as ty from glyphs group by page_num), c as (select t.page_num, t.tag, node_id, row_number() over (partition by t.page_num order by (case when (x0 + x1) / 2 <= tx then 0 else 1 end), abs((y0 + y1) / 2 - ty), abs((x0 + x1) / 2 - tx), node_id) as k from t join glyphs g on t.page_num = g.page_num and g.node_id <> t.tag where trim(text) <> '') select page_num, tag, node_id as anchor from c where k = 1")
def t14(spark, sf_dir):
    """The glyph that an equation's tag belongs to: the nearest in height left of it, else any."""
    g = glyphs(spark, sf_dir)
    t = g.groupBy("page_num").agg(F.expr("max_by(struct(node_id, x0, (y0 + y1) / 2 as ty), idx)").alias("t"))
    c = g.join(t, "page_num").where("node_id <> t.node_id and trim(text) <> ''")
    order = "struct(if((x0 + x1) / 2 <= t.x0, 0, 1), abs((y0 + y1) / 2 - t.ty), abs((x0 + x1) / 2 - t.x0), node_id)"
    return c.groupBy("page_num").agg(F.expr("first(t.node_id)").alias("tag"), F.expr(f"min_by(node_id, {order})").alias("anchor"))


@query("w19_grid_chains", f"with {GLYPHS}, c as (select page_num, node_id, (idx - 1) // 3 as r, (idx - 1) % 3 as c, size / 12 as confidence from glyphs), rows_ as (select page_num, r, arg_min(node_id, c) as anchor, min(confidence) as confidence from c group by all) select source, target, relation, confidence from (select anchor as source, lead(anchor) over (partition by page_num order by r) as target, 'MATRIX_ROW' as relation, least(confidence, lead(confidence) over (partition by page_num order by r)) as confidence from rows_ union all select node_id, lead(node_id) over (partition by page_num, r order by c), 'MATRIX_CELL', least(confidence, lead(confidence) over (partition by page_num, r order by c)) from c) where target is not null")
def w19(spark, sf_dir):
    """Chains of a grid: each row's anchor to the next, each cell to its neighbour, as sure as the less sure end."""
    c = glyphs(spark, sf_dir).selectExpr("page_num", "node_id", "(idx - 1) div 3 as r", "(idx - 1) % 3 as c", "size / 12 as confidence")
    rows = c.groupBy("page_num", "r").agg(F.expr("min_by(node_id, c)").alias("anchor"), F.min("confidence").alias("confidence"))
    w = "over (partition by page_num order by r)"
    a = rows.selectExpr("anchor as source", f"lead(anchor) {w} as target", "'MATRIX_ROW' as relation", f"least(confidence, lead(confidence) {w}) as confidence")
    w = "over (partition by page_num, r order by c)"
    b = c.selectExpr("node_id as source", f"lead(node_id) {w} as target", "'MATRIX_CELL' as relation", f"least(confidence, lead(confidence) {w}) as confidence")
    return a.unionByName(b).where("target is not null")


@query("w10_renumber", f"with {BLOCKS} select doc_id, block_id, 'p' || page_num || '_b' || (row_number() over (partition by doc_id, page_num order by y0, x0, n) - 1) as new_id from blocks")
def w10(spark, sf_dir):
    """Blocks numbered anew in reading order."""
    return blocks(spark, sf_dir).selectExpr("doc_id", "block_id", "concat('p', page_num, '_b', row_number() over (partition by doc_id, page_num order by y0, x0, n) - 1) as new_id")


@query(
    "f12_inline_runs",
    f"""with {GLYPHS}, g as (select *, regexp_matches(lower(font), 'cm|symbol|math') as m from glyphs), b as (select *, case when m and coalesce(lag(m) over (partition by page_num order by idx), false) then 0 else 1 end as starts from g),
    r as (select *, sum(starts) over (partition by page_num order by idx) as run from b where m), j as (select page_num, run, string_agg(text, '' order by idx) as latex, min(x0) as x0, max(x1) as x1, list_sort(list(distinct font)) as fonts, min(size) as least, max(size) as most from r group by all)
    select page_num, min(x0) over (partition by page_num, run) as x0, x1, '\\(' || trim(latex) || '\\)' as wrapped, array_to_string(fonts, ',') as fonts, least < 0.86 * most as has_script from j where trim(latex) <> '' and not regexp_full_match(trim(latex), '[,.;:()\\[\\]]|[*∗†‡§¶]+')""",
)
def f12(spark, sf_dir):
    """Runs of glyphs in mathematical fonts as inline formulas, with the evidence for them."""
    w = "over (partition by page_num order by idx)"
    g = glyphs(spark, sf_dir).withColumn("m", F.expr("lower(font) rlike 'cm|symbol|math'"))
    r = g.withColumn("starts", F.expr(f"if(m and coalesce(lag(m) {w}, false), 0, 1)")).where("m").withColumn("run", F.expr(f"sum(starts) {w}"))
    j = r.groupBy("page_num", "run").agg(F.expr("trim(array_join(transform(array_sort(collect_list(struct(idx, text))), s -> s.text), ''))").alias("latex"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.expr("array_join(array_sort(collect_set(font)), ',')").alias("fonts"), F.expr("min(size) < 0.86 * max(size)").alias("has_script"))
    return j.where("latex <> '' and not latex rlike '^([,.;:()\\\\[\\\\]]|[*∗†‡§¶]+)$'").selectExpr("page_num", "x0", "x1", f"concat({X.literal(chr(92) + '(')}, latex, {X.literal(chr(92) + ')')}) as wrapped", "fonts", "has_script")


@query("j13_shadowed_paragraphs", f"with {BLOCKS}, d as (select doc_id, page_num, x0 + 20 as x0, y0 as y0, x1 - 10 as x1, y1 + 1 as y1 from blocks where n % 6 = 1) select b.doc_id, b.block_id, {G.overlap_of_smaller('b.', 'd.')} >= 0.8 as shadowed from blocks b join d on b.doc_id = d.doc_id and b.page_num = d.page_num where b.block_type = 'paragraph' and {G.overlap_of_smaller('b.', 'd.')} >= 0.7")
def j13(spark, sf_dir):
    """Paragraphs that a detected region covers: mostly, and enough to be shadowed by it."""
    b = blocks(spark, sf_dir)
    d = b.where("n % 6 = 1").selectExpr("doc_id", "page_num", "x0 + 20 as dx0", "y0 as dy0", "x1 - 10 as dx1", "y1 + 1 as dy1")
    s = b.where("block_type = 'paragraph'").join(d, ["doc_id", "page_num"]).withColumn("share", F.expr(G.overlap_of_smaller("", "d")))
    return s.where("share >= 0.7").selectExpr("doc_id", "block_id", "share >= 0.8 as shadowed")


@query("d05_detector_merge", f"with {BLOCKS}, {FORMULAS}, d as (select result_id, page_num, (result_id % 200)::bigint as doc_id, (x0 % 300)::double as x0, (y0 % 700)::double as y0, (x0 % 300 + 230)::double as x1, (y0 % 700 + 12)::double as y1 from formulas), h as (select b.doc_id, b.block_id, d.result_id from blocks b join d on b.doc_id = d.doc_id and b.page_num = d.page_num where {G.intersection('b.', 'd.')} / greatest({G.width('d.')} * {G.height('d.')}, 1) > 0.3) select doc_id, block_id, 'retagged' as action from (select distinct doc_id, block_id from h) union all select doc_id, 'p' || page_num || '_b' || (1000 + row_number() over (partition by doc_id, page_num order by result_id)), 'appended' from d where result_id not in (select result_id from h)")
def d05(spark, sf_dir):
    """Detected regions merged into blocks: overlapped ones are retagged, others appended under fresh ids."""
    b = blocks(spark, sf_dir)
    d = formulas(spark, sf_dir).selectExpr("result_id", "cast(page_num as long) as page_num", "cast(result_id % 200 as long) as doc_id", "x0 % 300 as dx0", "y0 % 700 as dy0", "x0 % 300 + 230 as dx1", "y0 % 700 + 12 as dy1")
    h = b.join(d, ["doc_id", "page_num"]).where(f"{G.intersection('', 'd')} / greatest({G.width('d')} * {G.height('d')}, 1) > 0.3")
    a = h.select("doc_id", "block_id").distinct().withColumn("action", F.lit("retagged"))
    rest = d.join(h.select("result_id").distinct(), "result_id", "left_anti")
    return a.unionByName(rest.selectExpr("doc_id", "concat('p', page_num, '_b', 1000 + row_number() over (partition by doc_id, page_num order by result_id)) as block_id", "'appended' as action"))


@query("j35_anchor_window", f"with {GLYPHS}, a as (select page_num, min(x0) + 10 as wx0, 98::double as wy0, min(x0) + 60 as wx1, 112::double as wy1 from glyphs group by page_num), i as (select g.* from glyphs g join a on g.page_num = a.page_num and g.x0 < wx1 and wx0 < g.x1 and g.y0 < wy1 and wy0 < g.y1) select page_num, count(*) as glyphs, left(string_agg(text, '' order by idx), 500) as text, len((list_sort(list(node_id)))[1:400])::int as sampled from i group by page_num")
def j35(spark, sf_dir):
    """Glyphs in a window round an anchor: full counts, a bounded sample and text."""
    g = glyphs(spark, sf_dir)
    a = g.groupBy("page_num").agg(F.min("x0").alias("m")).selectExpr("page_num", "m + 10 as wx0", "98D as wy0", "m + 60 as wx1", "112D as wy1")
    i = g.join(a, "page_num").where("x0 < wx1 and wx0 < x1 and y0 < wy1 and wy0 < y1")
    return i.groupBy("page_num").agg(F.count("*").alias("glyphs"), F.expr("left(array_join(transform(array_sort(collect_list(struct(idx, text))), s -> s.text), ''), 500)").alias("text"), F.expr("size(slice(array_sort(collect_list(node_id)), 1, 400))").alias("sampled"))


@query("s22_coloured_capture", f"with {GLYPHS}, c as (select *, (cid * 37 % 16)::int as color from glyphs) select color, count(*) as n, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from c where color in (1, 5, 9) group by color")
def s22(spark, sf_dir):
    """Glyphs in marker colours, captured by colour."""
    marks = F.broadcast(spark.createDataFrame([(1,), (5,), (9,)], "color int"))
    c = glyphs(spark, sf_dir).withColumn("color", F.expr("cast(cid * 37 % 16 as int)")).join(marks, "color")
    return c.groupBy("color").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("p07_headings", f"with {GLYPHS}, m as (select page_num, (list_sort(list(size)))[count(*) // 2 + 1] as middle from glyphs group by page_num) select node_id, size > middle + 1.5 or (cid & 8) <> 0 as is_heading from glyphs join m using (page_num)")
def p07(spark, sf_dir):
    """Heading style: larger than the page's upper median by more than 1.5, or the bold flag."""
    g = glyphs(spark, sf_dir)
    m = g.groupBy("page_num").agg(F.expr("sort_array(collect_list(size))[cast(floor(count(*) / 2) as int)]").alias("middle"))
    return g.join(m, "page_num").selectExpr("node_id", "size > middle + 1.5 or (cid & 8) <> 0 as is_heading")


@query("g12_script_relations", f"with {GLYPHS}, p as (select node_id, lead(node_id) over w as target, (y0 + y1) / 2 as cy, lead((y0 + y1) / 2) over w as ty, y1 - y0 as h, lead(y1 - y0) over w as th from glyphs window w as (partition by page_num order by idx)) select node_id, target, case when th <= 0.92 * h and ty < cy - 0.12 * greatest(h, 1) then '^' when th <= 0.92 * h and ty > cy + 0.12 * greatest(h, 1) then '_' else '' end as script from p where target is not null")
def g12(spark, sf_dir):
    w = "over (partition by page_num order by idx)"
    p = glyphs(spark, sf_dir).selectExpr("node_id", f"lead(node_id) {w} as target", "(y0 + y1) / 2 as cy", f"lead((y0 + y1) / 2) {w} as ty", "y1 - y0 as h", f"lead(y1 - y0) {w} as th").where("target is not null")
    return p.selectExpr("node_id", "target", "case when th <= 0.92 * h and ty < cy - 0.12 * greatest(h, 1) then '^' when th <= 0.92 * h and ty > cy + 0.12 * greatest(h, 1) then '_' else '' end as script")


@query("g09_character_flags", rf"with {GLYPHS} select node_id, regexp_matches(text, '\p{{L}}') as letter, regexp_matches(text, '\p{{N}}') as number, regexp_matches(text, '[\p{{Sm}}+=<>|]') as symbol, regexp_matches(text, '\p{{P}}') as punctuation from glyphs")
def g09(spark, sf_dir):
    return glyphs(spark, sf_dir).selectExpr("node_id", "text rlike '\\\\p{L}' as letter", "text rlike '\\\\p{N}' as number", "text rlike '[\\\\p{Sm}+=<>|]' as symbol", "text rlike '\\\\p{P}' as punctuation")
