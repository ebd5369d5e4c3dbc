"""Glyph graphs: reading edges, relation candidates, nearest neighbours, runs, symbol repair and page health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions import geometry as G
from foliogrid.functions import text as X
from foliogrid.operators import pairs
from foliogrid.plans.base import BLOCKS, FORMULAS, GLYPHS, blocks, formulas, glyphs, query
from foliogrid.session import compilable

NEIGHBOURS, EDGES = pairs.NEIGHBOURS, 12


SCRIPT = 0.84


def marked(g: DataFrame) -> DataFrame:
    """Glyphs with ``unknown``, and ``script``: no larger than ``SCRIPT`` of their page's upper median size."""
    m = g.where("size > 0").groupBy("page_num").agg(F.expr("sort_array(collect_list(size))[cast(floor(count(*) / 2) as int)]").alias("middle"))
    return g.join(m, "page_num", "left").selectExpr(*g.columns, f"{X.unknown_glyph('text')} as unknown", f"coalesce(size <= middle * {SCRIPT}D, false) as script")


_MARKED = f"mid as (select page_num, (list_sort(list(size)))[count(*) // 2 + 1] as middle from glyphs where size > 0 group by page_num), mg as (select g.*, {X.unknown_glyph('text')} as unknown, coalesce(size <= middle * {SCRIPT}::double, false) as script from glyphs g left join mid using (page_num))"


@query("w01_reading_edges", f"with {GLYPHS}, e as (select page_num, node_id as source, lead(node_id) over (partition by page_num order by idx) as target from glyphs) select * from e where target is not null")
def w01(spark, sf_dir):
    e = glyphs(spark, sf_dir).selectExpr("page_num", "node_id as source", "lead(node_id) over (partition by page_num order by idx) as target")
    return e.where("target is not null")


@query("w02_neighbour_features", f"with {GLYPHS} select node_id, coalesce(font = lag(font) over w, false) as same_font_before, coalesce(abs(y1 - lag(y1) over w) <= 1, false) as same_baseline_before, x0 - lag(x1) over w as gap_before, lead(x0) over w - x1 as gap_after from glyphs window w as (partition by page_num order by idx)")
def w02(spark, sf_dir):
    w = "over (partition by page_num order by idx)"
    return glyphs(spark, sf_dir).selectExpr("node_id", f"coalesce(font = lag(font) {w}, false) as same_font_before", f"coalesce(abs(y1 - lag(y1) {w}) <= 1, false) as same_baseline_before", f"x0 - lag(x1) {w} as gap_before", f"lead(x0) {w} - x1 as gap_after")


@query(
    "w03_letter_runs",
    f"""with {GLYPHS}, g as (select *, regexp_full_match(text, '[a-z]') as letter from glyphs),
    b as (select *, case when letter and coalesce(lag(letter) over w, false) and abs(y1 - lag(y1) over w) <= 2 and x0 - lag(x1) over w <= 1.25::double * size then 0 else 1 end as starts from g window w as (partition by page_num order by idx)),
    r as (select *, sum(starts) over (partition by page_num order by idx) as run from b) select node_id, case when letter then count(*) over (partition by page_num, run) else 0 end as run_length from r""",
)
def w03(spark, sf_dir):
    """Runs of letters on one baseline without a wide gap: islands by a running sum of their starts."""
    w = "over (partition by page_num order by idx)"
    g = glyphs(spark, sf_dir).withColumn("letter", F.expr("text rlike '^[a-z]$'"))
    b = g.withColumn("starts", F.expr(f"if(letter and coalesce(lag(letter) {w}, false) and abs(y1 - lag(y1) {w}) <= 2 and x0 - lag(x1) {w} <= 1.25D * size, 0, 1)"))
    r = b.withColumn("run", F.expr(f"sum(starts) {w}"))
    return r.selectExpr("node_id", "if(letter, count(*) over (partition by page_num, run), 0) as run_length")


_PAIR = "from glyphs s join glyphs t on s.page_num = t.page_num and s.node_id <> t.node_id"
_DIST = f"sqrt(power({G.centre('t.', 'x')} - {G.centre('s.', 'x')}, 2) + power({G.centre('t.', 'y')} - {G.centre('s.', 'y')}, 2))"


_NODES = f"""nodes as (select page_num, node_id, 'glyph' as node_type, text, font, size, regexp_matches(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), 'CMEX|CMMI|CMSY|MSAM|MSBM|LMMath|Math|STIX|XITS|CambriaMath') as math, x0, y0, x1, y1 from glyphs
  union all select page_num, 'v' || page_num, 'vector', '', '', 0.0::double, false, (min(x0) + page_num % 9)::double, (101 + page_num % 13)::double, (min(x0) + page_num % 9 + 14 + page_num % 30)::double, (102 + page_num % 13)::double from glyphs group by page_num)"""
_NEAREST = f"""{_NODES}, o as (select *, row_number() over (partition by page_num order by x0, y0, node_id) as ord from nodes),
    p as (select s.page_num, s.node_id as source, t.node_id as target, {_DIST} + abs(t.ord - s.ord) * 0.25::double as score from o s join o t on s.page_num = t.page_num and s.node_id <> t.node_id),
    r as (select *, row_number() over (partition by page_num, source order by round(score, 9), target) as place from p),
    near as (select page_num, source, target, place::int as place, score from r where place <= {NEIGHBOURS} union all select page_num, node_id, node_id, 0, 0.0 from nodes where node_type = 'vector')"""


def page_nodes(spark, sf_dir) -> DataFrame:
    """Nodes of a page's graph: its glyphs and one drawn mark, whose place follows from the page's number."""
    g = glyphs(spark, sf_dir)
    math = f"{X.font_family('font')} rlike 'CMEX|CMMI|CMSY|MSAM|MSBM|LMMath|Math|STIX|XITS|CambriaMath' as math"
    own = g.selectExpr("page_num", "node_id", "'glyph' as node_type", "text", "font", "size", math, "x0", "y0", "x1", "y1")
    mark = g.groupBy("page_num").agg(F.min("x0").alias("x")).selectExpr("page_num", "concat('v', page_num) as node_id", "'vector' as node_type", "'' as text", "'' as font", "0D as size", "false as math", "x + page_num % 9 as x0", "cast(101 + page_num % 13 as double) as y0", "x + page_num % 9 + 14 + page_num % 30 as x1", "cast(102 + page_num % 13 as double) as y1")
    return own.unionByName(mark)


@query("j17_nearest_glyphs", f"with {GLYPHS}, {_NEAREST} select source, target, place, round(score, 6) as score from near")
def j17(spark, sf_dir):
    """The 16 nearest nodes of each on its page, by distance and by how far apart they are in reading order; a mark also pairs with itself."""
    return pairs.nearest_pairs(page_nodes(spark, sf_dir)).select("source", "target", "place", F.round("score", 6).alias("score"))


def relation_edges(g: DataFrame) -> DataFrame:
    """Candidate relations: pairs with a hint, the best ``EDGES`` of each source (T8), with their features.

    A source is a node of a page: ids may come again on other pages. Ranked by page, too, pairs stay where the page is.
    """
    features = {name: F.expr(sql) if sql.startswith("case") else F.round(F.expr(sql), 6) for name, sql in G.edge_features("s_", "t_").items()}
    # what the ranking needs comes first, the rest when it is done
    first = {name: features.pop(name) for name in ("dx_over_height", "dy_over_height")}
    place = f"row_number() over (partition by s_page_num, s_node_id order by {G.hint_order('hint')}, round(abs(dx_over_height) + abs(dy_over_height), 6), edge_id)"

    def best(p: DataFrame) -> DataFrame:
        p = p.withColumn("hint", F.expr(G.relation_hint("s_", "t_"))).where("hint is not null").withColumns(first)
        p = p.withColumn("edge_id", F.concat_ws(":", F.concat_ws("->", "s_node_id", "t_node_id"), "hint"))
        return p.withColumn("place", F.expr(place)).where(F.col("place") <= EDGES)

    small, large = pairs.sided_pairs(marked(compilable(g)))
    return best(small).unionByName(best(large)).withColumns(features)


_FEATURES = ", ".join(f"{sql if sql.startswith('case') else f'round({sql}, 6)'} as {name}" for name, sql in G.edge_features("s.", "t.").items())


@query(
    "t08_relation_edges",
    f"""with {GLYPHS}, {_MARKED}, p as (select s.node_id as source, t.node_id as target, {G.relation_hint('s.', 't.')} as hint, {_FEATURES} from mg s join mg t on s.page_num = t.page_num and s.node_id <> t.node_id),
    e as (select *, source || '->' || target || ':' || hint as edge_id from p where hint is not null),
    r as (select *, row_number() over (partition by source order by {G.hint_order('hint')}, round(abs(dx_over_height) + abs(dy_over_height), 6), edge_id) as place from e)
    select edge_id, source, target, hint, place::int as place, {', '.join(G.edge_features('s.', 't.'))} from r where place <= {EDGES}""",
)
def t08(spark, sf_dir):
    return relation_edges(glyphs(spark, sf_dir)).selectExpr("edge_id", "s_node_id as source", "t_node_id as target", "hint", "place", *G.edge_features("s_", "t_"))


_EDGES = f"{_MARKED}, p as (select s.page_num, s.node_id as source, t.node_id as target, {G.relation_hint('s.', 't.')} as hint, {_FEATURES} from mg s join mg t on s.page_num = t.page_num and s.node_id <> t.node_id), rk as (select *, row_number() over (partition by source order by {G.hint_order('hint')}, round(abs(dx_over_height) + abs(dy_over_height), 6), source || '->' || target || ':' || hint) as place from p where hint is not null), e as (select * from rk where place <= {EDGES})"


@query(
    "a26_graph_stats",
    rf"""with {GLYPHS}, {_EDGES}, h as (select page_num, string_agg(hint || ':' || n, ',' order by hint) as hints, sum(n)::bigint as edges from (select page_num, hint, count(*) as n from e group by all) group by page_num),
    f as (select page_num, regexp_replace(font, '^[A-Z]{{6}}\+', '') as font, count(*) as n from glyphs group by all), t as (select *, row_number() over (partition by page_num order by n desc, font) as k from f),
    fs as (select page_num, count(*) as fonts, string_agg(font || ':' || n, ',' order by k) filter (where k <= 12) as top_fonts from t group by page_num),
    g as (select page_num, count(*) as glyphs, count(*) filter (where regexp_matches(font, 'CMEX|CMMI|CMSY|Math')) as math_glyphs, count(*) filter (where script) as script_glyphs, count(*) filter (where unknown) as unknown_glyphs from mg group by page_num)
    select g.page_num, glyphs, coalesce(edges, 0) as edges, coalesce(hints, '') as hints, fonts, top_fonts, math_glyphs, script_glyphs, unknown_glyphs from g join fs using (page_num) left join h using (page_num)""",
)
def a26(spark, sf_dir):
    """A page's graph in numbers: edges by hint, its twelve commonest fonts, and glyphs of mathematical fonts, script size and unknown ones."""
    g = glyphs(spark, sf_dir)
    listed = lambda x, k: f"array_join(transform(array_sort(collect_list(struct({k}))), s -> concat({x})), ',')"
    h = relation_edges(g).groupBy(F.col("s_page_num").alias("page_num"), "hint").agg(F.count("*").alias("n")).groupBy("page_num").agg(F.expr(listed("s.hint, ':', s.n", "hint, n")).alias("hints"), F.sum("n").alias("edges"))
    f = g.groupBy("page_num", F.expr(X.font_name("font")).alias("font")).agg(F.count("*").alias("n"))
    top = f.groupBy("page_num").agg(F.count("*").alias("fonts"), F.expr("array_join(transform(slice(array_sort(collect_list(struct(-n as k, font, n))), 1, 12), s -> concat(s.font, ':', s.n)), ',')").alias("top_fonts"))
    own = marked(g).groupBy("page_num").agg(F.count("*").alias("glyphs"), F.expr("count_if(font rlike 'CMEX|CMMI|CMSY|Math')").alias("math_glyphs"), F.expr("count_if(script)").alias("script_glyphs"), F.expr("count_if(unknown)").alias("unknown_glyphs"))
    return own.join(top, "page_num").join(h, "page_num", "left").selectExpr("page_num", "glyphs", "coalesce(edges, 0) as edges", "coalesce(hints, '') as hints", "fonts", "top_fonts", "math_glyphs", "script_glyphs", "unknown_glyphs")


def page_distance(a: str, b: str) -> str:
    return f"sqrt(power({G.centre(b, 'x')} - {G.centre(a, 'x')}, 2) + power({G.centre(b, 'y')} - {G.centre(a, 'y')}, 2))"


_GRAPH = f"""{_NEAREST}, gb as (select page_num, count(*) as nodes, count(*) filter (where node_type = 'glyph') as glyph_count, count(*) filter (where node_type = 'vector') as vector_count, greatest(max(x1) - min(x0), 0.000001) as gw, greatest(max(y1) - min(y0), 0.000001) as gh from nodes group by page_num),
  d as (select near.page_num, source, target, a.node_type as s_type, b.node_type as t_type, gb.*exclude (page_num), {page_distance('a.', 'b.')} / greatest(gw, gh, 1.0) as distance from near join nodes a on a.page_num = near.page_num and a.node_id = source join nodes b on b.page_num = near.page_num and b.node_id = target join gb on gb.page_num = near.page_num)"""


def graph_distances(nodes: DataFrame, degrees: bool = False) -> DataFrame:
    """The nearest pairs with their pages' counts and spans, and their distance as a share of the larger span.

    ``degrees`` adds ``source_in``, the pairs that end at a pair's source, and ``target_out``, those that start at its target. They are
    counted before distances are known and reach the nodes, of which there are many times fewer than pairs.
    """
    near = pairs.nearest_pairs(nodes).select("page_num", "source", "target")
    box = nodes.groupBy("page_num").agg(F.count("*").alias("nodes"), F.expr("count_if(node_type = 'glyph')").alias("glyph_count"), F.expr("count_if(node_type = 'vector')").alias("vector_count"), F.expr("greatest(max(x1) - min(x0), 0.000001D)").alias("gw"), F.expr("greatest(max(y1) - min(y0), 0.000001D)").alias("gh"))
    side = lambda p, k: nodes.select("page_num", F.col("node_id").alias(k), F.col("node_type").alias(f"{p}_type"), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")])
    s, t = side("s", "source"), side("t", "target")
    if degrees:
        s = s.join(near.groupBy("page_num", F.col("target").alias("source")).agg(F.count("*").alias("source_in")), ["page_num", "source"], "left").na.fill(0, ["source_in"])
        t = t.join(near.groupBy("page_num", F.col("source").alias("target")).agg(F.count("*").alias("target_out")), ["page_num", "target"], "left").na.fill(0, ["target_out"])
    d = near.join(s, ["page_num", "source"]).join(t, ["page_num", "target"]).join(box, "page_num")
    return d.selectExpr(*(["source_in", "target_out"] if degrees else []), "page_num", "source", "target", "s_type", "t_type", "nodes", "glyph_count", "vector_count", "gw", "gh", f"{page_distance('s_', 't_')} / greatest(gw, gh, 1.0D) as distance")


@query(
    "a35_node_degrees",
    f"""with {GLYPHS}, {_GRAPH}, outs as (select page_num, source as node_id, count(*) as out_degree, min(distance) as nearest, avg(distance) as mean, count(*) filter (where t_type = 'vector') as rules from d group by all),
    ins as (select page_num, target as node_id, count(*) as in_degree, min(distance) as in_nearest, avg(distance) as in_mean, count(*) filter (where s_type = 'vector') as in_rules from d group by all)
    select page_num, node_id, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree, round(nearest, 6) as nearest, round(mean, 6) as mean, round(in_nearest, 6) as in_nearest, round(in_mean, 6) as in_mean, coalesce(rules, 0) as rules, coalesce(in_rules, 0) as in_rules from outs full join ins using (page_num, node_id)""",
)
def a35(spark, sf_dir):
    """Degrees, distances and neighbouring marks of each node among the nearest pairs, as a source and as a target."""
    d = graph_distances(page_nodes(spark, sf_dir))
    ends = d.selectExpr("page_num", "inline(array(struct(source as node_id, distance as o, cast(null as double) as i, t_type = 'vector' as r, false as q), struct(target as node_id, cast(null as double) as o, distance as i, false as r, s_type = 'vector' as q)))")
    return ends.groupBy("page_num", "node_id").agg(F.count("o").alias("out_degree"), F.count("i").alias("in_degree"), F.round(F.min("o"), 6).alias("nearest"), F.round(F.avg("o"), 6).alias("mean"), F.round(F.min("i"), 6).alias("in_nearest"), F.round(F.avg("i"), 6).alias("in_mean"), F.expr("count_if(r)").alias("rules"), F.expr("count_if(q)").alias("in_rules"))


@query("w04_distance_ranks", f"with {GLYPHS}, {_GRAPH} select source, target, rank() over w::int as place, (rank() over w - 1) / greatest(count(*) over (partition by page_num, source) - 1, 1) as share from d window w as (partition by page_num, source order by round(distance, 9))")
def w04(spark, sf_dir):
    """Each source's nearest pairs by distance: rank and percentile."""
    w = "over (partition by page_num, source order by round(distance, 9))"
    return graph_distances(page_nodes(spark, sf_dir)).selectExpr("source", "target", f"rank() {w} as place", f"(rank() {w} - 1) / greatest(count(*) over (partition by page_num, source) - 1, 1) as share")


@query("a11_page_health", f"with {GLYPHS} select page_num, count(*) as glyphs, count(*) filter (where text in ('', '\ufffd') or left(text, 4) = 'cid:') as unknown, round(count(*) filter (where text in ('', '\ufffd') or left(text, 4) = 'cid:') / count(*), 6) as unknown_rate, count(distinct regexp_replace(font, '^[A-Z]{{6}}\\+', '')) as fonts, bool_or(text in ('', '\ufffd') or left(text, 4) = 'cid:') as needs_repair from glyphs group by page_num")
def a11(spark, sf_dir):
    """Counts and flags of a page's glyphs."""
    g = glyphs(spark, sf_dir).withColumn("unknown_glyph", F.expr("text in ('', '\ufffd') or left(text, 4) = 'cid:'")).withColumn("plain", F.expr(X.font_name("font")))
    return g.groupBy("page_num").agg(F.count("*").alias("glyphs"), F.expr("count_if(unknown_glyph)").alias("unknown"), F.expr("round(count_if(unknown_glyph) / count(*), 6)").alias("unknown_rate"), F.countDistinct("plain").alias("fonts"), F.expr("bool_or(unknown_glyph)").alias("needs_repair"))


_ANCHORS = "a as (select f, cid, min(text) as text, count(distinct text) as kinds from k where known group by f, cid)"


@query(
    "j19_symbol_repair",
    f"""with {GLYPHS}, k as (select *, regexp_replace(font, '^[A-Z]{{6}}\\+', '') as f, not (text in ('', '\ufffd') or left(text, 4) = 'cid:') as known from glyphs), {_ANCHORS}
    select k.node_id, case when k.known then k.text when a.kinds = 1 then a.text else '' end as resolved, case when k.known then 'pdf_text' when a.kinds = 1 then 'font_cid_anchor' when a.kinds > 1 then 'conflict' else 'unresolved' end as source from k left join a on k.f = a.f and k.cid = a.cid""",
)
def j19(spark, sf_dir):
    """Unknown glyphs take the text that their font and code have elsewhere, if it is always the same one (A10)."""
    k = glyphs(spark, sf_dir).withColumn("f", F.expr(X.font_name("font"))).withColumn("known", F.expr("not (text in ('', '\ufffd') or left(text, 4) = 'cid:')"))
    a = k.where("known").groupBy("f", "cid").agg(F.min("text").alias("anchor"), F.countDistinct("text").alias("kinds"))
    return k.join(a, ["f", "cid"], "left").selectExpr("node_id", "case when known then text when kinds = 1 then anchor else '' end as resolved", "case when known then 'pdf_text' when kinds = 1 then 'font_cid_anchor' when kinds > 1 then 'conflict' else 'unresolved' end as source")


@query(
    "a12_repair_summary",
    f"""with {GLYPHS}, k as (select *, regexp_replace(font, '^[A-Z]{{6}}\\+', '') as f, not (text in ('', '\ufffd') or left(text, 4) = 'cid:') as known from glyphs), {_ANCHORS}
    select count(*) filter (where not known) as unknown_before, count(*) filter (where not known and coalesce(kinds, 0) <> 1) as unknown_after, count(*) filter (where not known and kinds = 1) as repaired, count(*) filter (where not known and kinds > 1) as conflicts from k left join a on k.f = a.f and k.cid = a.cid""",
)
def a12(spark, sf_dir):
    s = j19(spark, sf_dir)
    return s.agg(F.expr("count_if(source <> 'pdf_text')").alias("unknown_before"), F.expr("count_if(source in ('conflict', 'unresolved'))").alias("unknown_after"), F.expr("count_if(source = 'font_cid_anchor')").alias("repaired"), F.expr("count_if(source = 'conflict')").alias("conflicts"))


@query("w13_script_size", f"with {GLYPHS}, m as (select page_num, max(size) as top, (list_sort(list(size)))[count(*) // 2 + 1] as middle from glyphs group by page_num) select node_id, size <= 0.84::double * middle as script_of_median, size <= 0.82::double * top as script_of_max from glyphs join m using (page_num)")
def w13(spark, sf_dir):
    """Script marks against a page's upper median size, and against its largest."""
    g = glyphs(spark, sf_dir)
    m = g.groupBy("page_num").agg(F.max("size").alias("top"), F.expr("sort_array(collect_list(size))[cast(floor(count(*) / 2) as int)]").alias("middle"))
    return g.join(m, "page_num").selectExpr("node_id", "size <= 0.84D * middle as script_of_median", "size <= 0.82D * top as script_of_max")


@query("a13_page_boxes", f"with {GLYPHS} select page_num, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, string_agg(text, '' order by idx) as text from glyphs group by page_num")
def a13(spark, sf_dir):
    return glyphs(spark, sf_dir).groupBy("page_num").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.expr("array_join(transform(array_sort(collect_list(struct(idx, text))), s -> s.text), '')").alias("text"))


@query("j15_glyphs_in_regions", f"with {GLYPHS}, r as (select page_num, 0::double as x0, 100::double as y0, 40::double as x1, 108::double as y1 from (select distinct page_num from glyphs)) select g.page_num, count(*) as n, string_agg(g.node_id, ',' order by g.idx) as members from glyphs g join r on g.page_num = r.page_num and {G.intersects('g.', 'r.')} group by g.page_num")
def j15(spark, sf_dir):
    """Glyphs that cross a region of their page."""
    g = glyphs(spark, sf_dir)
    r = g.select("page_num").distinct().selectExpr("page_num", "0D as rx0", "100D as ry0", "40D as rx1", "108D as ry1")
    inside = g.join(r, "page_num").where(G.intersects("", "r").replace("rx", "rx"))
    return inside.groupBy("page_num").agg(F.count("*").alias("n"), F.expr("array_join(transform(array_sort(collect_list(struct(idx, node_id))), s -> s.node_id), ',')").alias("members"))


@query("j12_region_overlap", f"with {BLOCKS}, {FORMULAS}, d as (select result_id, page_num, (x0 % 300)::double as x0, (y0 % 600)::double as y0, (x0 % 300 + 220)::double as x1, (y0 % 600 + 60)::double as y1 from formulas), o as (select doc_id, block_id, result_id, {G.intersection('b.', 'd.')} / greatest({G.width('d.')} * {G.height('d.')}, 1) as share from blocks b join d on b.page_num = d.page_num where doc_id % 10 = d.result_id % 10) select doc_id, block_id, result_id, round(share, 6) as share from o where share > 0.05")
def j12(spark, sf_dir):
    """Blocks against detected regions of their page: an equi join on page, then the share of the region's area."""
    d = formulas(spark, sf_dir).selectExpr("result_id", "page_num", "result_id % 10 as lane", "x0 % 300 as dx0", "y0 % 600 as dy0", "x0 % 300 + 220 as dx1", "y0 % 600 + 60 as dy1")
    b = blocks(spark, sf_dir).withColumn("lane", F.expr("doc_id % 10"))
    share = f"{G.intersection('', 'd')} / greatest({G.width('d')} * {G.height('d')}, 1)"
    return b.join(d, ["page_num", "lane"]).withColumn("share", F.expr(share)).where("share > 0.05").select("doc_id", "block_id", "result_id", F.round("share", 6).alias("share"))


@query("p20_rules", f"with {GLYPHS}, r as (select node_id, x0, y0, x0 + size * 6 as x1, y0 + 1 + idx % 3 as y1 from glyphs) select node_id, {G.is_rule('r.')} as horizontal, {G.is_rule('r.', False)} as vertical from r")
def p20(spark, sf_dir):
    r = glyphs(spark, sf_dir).selectExpr("node_id", "x0 as rx0", "y0 as ry0", "x0 + size * 6 as rx1", "y0 + 1 + idx % 3 as ry1")
    return r.selectExpr("node_id", f"{G.is_rule('r')} as horizontal", f"{G.is_rule('r', False)} as vertical")


_COLUMNS = """
m as (select doc_id, page_num, (list_sort(list(x0)))[count(*) // 2 + 1] as mid, count(*) as n from blocks group by all),
s as (select b.*, m.mid, m.n as all_n, b.x0 >= m.mid as is_right from blocks b join m using (doc_id, page_num)),
g as (select doc_id, page_num, any_value(all_n) as n, count(*) filter (where not is_right) as l, count(*) filter (where is_right) as r,
  (list_sort(list(x1) filter (where not is_right)))[count(*) filter (where not is_right) // 2 + 1] as left_mid,
  (list_sort(list(x0) filter (where is_right)))[count(*) filter (where is_right) // 2 + 1] as right_mid from s group by all)
"""


@query("w11_columns", f"with {BLOCKS}, {_COLUMNS} select doc_id, page_num, coalesce(n >= 6 and l >= 3 and r >= 3 and right_mid - left_mid > 50, false) as two_columns from g")
def w11(spark, sf_dir):
    """Whether a page has two columns: a split at the upper median, three blocks on either side, a gap between."""
    b = blocks(spark, sf_dir)
    mid = lambda x, keep="true": f"sort_array(collect_list(if({keep}, {x}, null)))[cast(floor(count_if({keep}) / 2) as int)]"
    m = b.groupBy("doc_id", "page_num").agg(F.expr(mid("x0")).alias("mid"), F.count("*").alias("all_n"))
    s = b.join(m, ["doc_id", "page_num"]).withColumn("right", F.expr("x0 >= mid"))
    g = s.groupBy("doc_id", "page_num").agg(F.first("all_n").alias("n"), F.expr("count_if(not right)").alias("l"), F.expr("count_if(right)").alias("r"), F.expr("get(sort_array(collect_list(if(not right, x1, null))), cast(floor(count_if(not right) / 2) as int))").alias("left_mid"), F.expr("get(sort_array(collect_list(if(right, x0, null))), cast(floor(count_if(right) / 2) as int))").alias("right_mid"))
    return g.selectExpr("doc_id", "page_num", "coalesce(n >= 6 and l >= 3 and r >= 3 and right_mid - left_mid > 50, false) as two_columns")


@query("w14_page_priority", f"with {BLOCKS}, p as (select doc_id, page_num, least(8 * count(*) filter (where block_type = 'image') + 5 * count(*) filter (where block_type = 'formula') + sum(length(content) - length(translate(content, '=+-*/^_()[]{{}}∈≤≥×·√∑∫', ''))), 100)::bigint as score, count(*) as n from blocks group by all), r as (select *, row_number() over (partition by doc_id order by score desc, page_num) as place from p) select doc_id, page_num, score, place::int as place from r where place <= 6")
def w14(spark, sf_dir):
    """Pages by how much mathematics they may hold, within a budget."""
    p = blocks(spark, sf_dir).groupBy("doc_id", "page_num").agg(F.expr(f"cast(least(8 * count_if(block_type = 'image') + 5 * count_if(block_type = 'formula') + sum({X.count_of('content', '=+-*/^_()[]{}∈≤≥×·√∑∫')}), 100) as long)").alias("score"))
    r = p.withColumn("place", F.expr("row_number() over (partition by doc_id order by score desc, page_num)"))
    return r.where("place <= 6").select("doc_id", "page_num", "score", "place")
