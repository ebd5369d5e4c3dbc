"""The vectors that a graph parser sees: 26 features of a pair, 39 of a node, 26 of a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.functions import geometry as G
from foliogrid.operators import pairs
from foliogrid.plans.base import GLYPHS, query
from foliogrid.plans.glyphs import _GRAPH, _NEAREST, _NODES, graph_distances, page_distance, page_nodes

#: How level and how near letters of one run stand, and the gap of a node without a neighbour.
LEVEL, NEAR, ALONE = 0.72, 1.25, 10.0
_SEEN = "row_number() over (partition by page_num order by x0, y0, node_id) - 1 as ord, count(*) over (partition by page_num) as nodes"
_ROUND = lambda features: [f"round({sql}, 6) as {name}" for name, sql in features.items()]


@query("g08_pair_features", f"with {GLYPHS}, {_NEAREST}, q as (select *, {_SEEN} from nodes) select source, target, {', '.join(f'round(({sql})::double, 6) as {name}' for name, sql in G.pair_features('s.', 't.').items())} from near n join q s on s.page_num = n.page_num and s.node_id = source join q t on t.page_num = n.page_num and t.node_id = target")
def g08_pairs(spark, sf_dir):
    """Geometry, fonts, rules and places of the nearest pairs."""
    nodes = page_nodes(spark, sf_dir)
    seen = nodes.selectExpr("*", *_SEEN.split(", count")[:1], "count(*) over (partition by page_num) as nodes")
    side = lambda p: seen.select(*[F.col(c).alias(f"{p}_{c}") for c in seen.columns])
    near = pairs.nearest_pairs(nodes).select("page_num", "source", "target")
    both = near.join(side("s"), (F.col("s_page_num") == F.col("page_num")) & (F.col("s_node_id") == F.col("source"))).join(side("t"), (F.col("t_page_num") == F.col("page_num")) & (F.col("t_node_id") == F.col("target")))
    return both.selectExpr("source", "target", *[f"round(cast({sql} as double), 6) as {name}" for name, sql in G.pair_features("s_", "t_").items()])


_KINDS = {"letter": "L", "number": "N", "symbol": "S", "punctuation": "P", "separator": "Z", "mark": "M"}


def _runs(like: str) -> list[tuple[str, list[str]]]:
    """Steps of columns that both dialects read: neighbours, links to the one before, runs by running sums of their starts."""
    w = "over (partition by page_num order by x0, y0, node_id)"
    back = {c: f"lag({c}) {w} as p_{c}" for c in ("font", "x0", "y0", "x1", "y1", "letter")}
    ahead = {c: f"lead({c}) {w} as n_{c}" for c in ("font", "x0", "y0", "x1", "y1")}
    return [
        ("a", ["*", f"{like} as letter"]),
        ("b", ["*", *back.values(), *ahead.values()]),
        ("c", ["*", f"coalesce(letter and p_letter and {G.alignment('p_', '')} >= {LEVEL} and {G.gap_in_heights('p_', '')} <= {NEAR}, false) as linked"]),
        ("d", ["*", f"sum(case when linked then 0 else 1 end) {w} as run", f"sum(case when linked and p_font = font then 0 else 1 end) {w} as font_run"]),
        ("e", ["*", f"row_number() over (partition by page_num, run order by x0, y0, node_id) - 1 as place", "count(*) over (partition by page_num, run) as size_run", "count(*) over (partition by page_num, font_run) as size_font_run"]),
    ]


_RUN_FEATURES = {
    "prev_same_font": "coalesce(case when p_font = font then 1.0 else 0.0 end, 0.0)",
    "next_same_font": "coalesce(case when n_font = font then 1.0 else 0.0 end, 0.0)",
    "prev_baseline_alignment": f"coalesce({G.alignment('p_', '')}, 0.0)",
    "next_baseline_alignment": f"coalesce({G.alignment('', 'n_')}, 0.0)",
    "prev_horizontal_gap": f"coalesce(case when p_x1 is not null then {G.gap_in_heights('p_', '')} end, {ALONE})",
    "next_horizontal_gap": f"coalesce(case when n_x0 is not null then {G.gap_in_heights('', 'n_')} end, {ALONE})",
    "letter_run_left": "case when letter then place else 0 end",
    "letter_run_right": "case when letter then size_run - 1 - place else 0 end",
    "letter_run_length": "case when letter then size_run else 0 end",
    "same_font_letter_run_length": "case when letter then size_font_run else 0 end",
}
_ALONE = {name: f"{ALONE}" if name.endswith("gap") else "0.0" for name in _RUN_FEATURES}
_DUCK_RUNS = ", ".join(f"{name}_ as (select {', '.join(cols)} from {'inked' if name == 'a' else f'{prev}_'})" for (name, cols), prev in zip(_runs("regexp_matches(text, '\\p{L}')"), " abcd"))
_DUCK_KINDS = ", ".join(f"case when regexp_matches(text, '\\p{{{c}}}') then 1.0 else 0.0 end as text_has_{n}" for n, c in _KINDS.items()) + ", case when text <> '' and regexp_full_match(text, '[\\x00-\\x7F]*') then 1.0 else 0.0 end as text_is_ascii"
_PAGE = "min(x0) over (partition by page_num) as gx0, min(y0) over (partition by page_num) as gy0, max(x1) over (partition by page_num) as gx1, max(y1) over (partition by page_num) as gy1"


@query(
    "g08_node_features",
    f"""with {GLYPHS}, {_NODES}, inked as (select * from nodes where node_type = 'glyph' and trim(text) <> ''), {_DUCK_RUNS}, r as (select page_num as pn, node_id as id, {', '.join(f'{sql} as {name}' for name, sql in _RUN_FEATURES.items())} from e_),
    m as (select page_num as mp, avg(size) filter (where size > 0) as mean_size from nodes group by page_num), q as (select *, {_SEEN}, {_PAGE} from nodes)
    select page_num, node_id, {', '.join(f'round(({sql})::double, 6) as {name}' for name, sql in G.node_features().items())}, {_DUCK_KINDS}, {', '.join(f'round(coalesce(r.{name}, {_ALONE[name]})::double, 6) as {name}' for name in _RUN_FEATURES)}
    from q join (select mp, coalesce(mean_size, 0) as mean_size from m) on mp = page_num left join r on r.pn = page_num and r.id = node_id""",
)
def g08_nodes(spark, sf_dir):
    """Size, place, text, font and the run of letters that a node stands in."""
    nodes = page_nodes(spark, sf_dir)
    runs = nodes.where("node_type = 'glyph' and trim(text) <> ''")
    for _, columns in _runs("text rlike '\\\\p{L}'"):
        runs = runs.selectExpr(*columns)
    runs = runs.selectExpr("page_num", "node_id", *[f"cast({sql} as double) as {name}" for name, sql in _RUN_FEATURES.items()])
    seen = nodes.selectExpr("*", _SEEN.split(", count")[0], "count(*) over (partition by page_num) as nodes", *[f"{f}({c}) over (partition by page_num) as g{c}" for f, c in (("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1"))], "coalesce(avg(if(size > 0, size, null)) over (partition by page_num), 0D) as mean_size")
    kinds = [f"if(text rlike '\\\\p{{{c}}}', 1.0D, 0.0D) as text_has_{n}" for n, c in _KINDS.items()] + ["if(text <> '' and text rlike '^[\\\\x00-\\\\x7F]*$', 1.0D, 0.0D) as text_is_ascii"]
    own = [f"round(cast({sql} as double), 6) as {name}" for name, sql in G.node_features().items()]
    return seen.join(runs, ["page_num", "node_id"], "left").selectExpr("page_num", "node_id", *own, *kinds, *[f"round(coalesce({name}, {_ALONE[name]}), 6) as {name}" for name in _RUN_FEATURES])


_GRAPH_FEATURES = {
    "bias": "1.0",
    "node_count": "greatest(1, nodes) * 1.0",
    "glyph_count": "glyph_count * 1.0",
    "vector_count": "vector_count * 1.0",
    "candidate_pair_count": "pairs_n * 1.0",
    "graph_width": "gw",
    "graph_height": "gh",
    "graph_aspect_ratio": "least(1000.0, gw / gh)",
    "candidate_density": "pairs_n * 1.0 / (greatest(1, nodes) * greatest(1, nodes))",
    **{f"{a}_{b}_degree": f"{a}_{b} * 1.0" for a in ("source", "target") for b in ("out", "in")},
    **{f"{a}_{b}_degree_ratio": f"{a}_{b} * 1.0 / pairs_n" for a in ("source", "target") for b in ("out", "in")},
    "candidate_distance_rank": "place * 1.0",
    "candidate_distance_rank_ratio": "place * 1.0 / greatest(1, source_out)",
    "candidate_distance_percentile": "(place - 1) * 1.0 / greatest(1, source_out - 1)",
    "source_min_distance": "source_min",
    "source_mean_distance": "source_mean",
    "target_min_distance": "target_min",
    "target_mean_distance": "target_mean",
    "source_rule_neighbor_count": "source_rules * 1.0",
    "target_rule_neighbor_count": "target_rules * 1.0",
}
_STATS = {
    "place": "rank() over (partition by page_num, source order by round(distance, 9))",
    "source_min": "min(distance) over (partition by page_num, source)",
    "source_mean": "avg(distance) over (partition by page_num, source)",
    "target_min": "min(distance) over (partition by page_num, target)",
    "target_mean": "avg(distance) over (partition by page_num, target)",
    "source_rules": "sum(case when t_type = 'vector' then 1 else 0 end) over (partition by page_num, source)",
    "target_rules": "sum(case when s_type = 'vector' then 1 else 0 end) over (partition by page_num, target)",
    "source_out": "count(*) over (partition by page_num, source)",
    "target_in": "count(*) over (partition by page_num, target)",
    "pairs_n": "count(*) over (partition by page_num)",
}


@query(
    "g08_graph_features",
    f"""with {GLYPHS}, {_GRAPH}, w as (select *, {', '.join(f'{sql} as {name}' for name, sql in _STATS.items())} from d),
    ins as (select page_num, target as node_id, count(*) as n from d group by all), outs as (select page_num, source as node_id, count(*) as n from d group by all),
    x as (select w.*, coalesce(ins.n, 0) as source_in, coalesce(outs.n, 0) as target_out from w left join ins on ins.page_num = w.page_num and ins.node_id = source left join outs on outs.page_num = w.page_num and outs.node_id = target)
    select source, target, {', '.join(f'round(({sql})::double, 6) as {name}' for name, sql in _GRAPH_FEATURES.items())} from x""",
)
def g08_graph(spark, sf_dir):
    """A pair among its graph: counts, spans, degrees, distances and their ranks."""
    nodes, page = page_nodes(spark, sf_dir), "over (partition by page_num)"
    seen = nodes.selectExpr("page_num", "node_id", "node_type", "x0", "y0", "x1", "y1", "(x0 + x1) / 2 as x", "(y0 + y1) / 2 as y", "row_number() over (partition by page_num order by x0, y0, node_id) as ord", f"count(*) {page} as nodes")
    # pages up to `ALL` are dealt by page once: pairs carry what they need, and no join or window deals them anew
    small = seen.where(f"nodes <= {pairs.ALL}")
    p = pairs.twin(small).where("s_node_id <> t_node_id or s_node_type = 'vector'").withColumn("self", F.expr("s_node_id = t_node_id"))
    p = p.withColumn("score", F.expr(f"sqrt(power(t_x - s_x, 2) + power(t_y - s_y, 2)) + abs(t_ord - s_ord) * {pairs.STEP}D"))
    p = p.withColumn("nearest", F.expr("row_number() over (partition by s_page_num, s_node_id order by self, round(score, 9), t_node_id)")).where(f"self or nearest <= {pairs.NEIGHBOURS}")
    box = small.groupBy("page_num").agg(F.expr("count_if(node_type = 'glyph')").alias("glyph_count"), F.expr("count_if(node_type = 'vector')").alias("vector_count"), F.expr("greatest(max(x1) - min(x0), 0.000001D)").alias("gw"), F.expr("greatest(max(y1) - min(y0), 0.000001D)").alias("gh"))
    d = p.selectExpr("s_page_num as page_num", "s_node_id as source", "t_node_id as target", "s_node_type as s_type", "t_node_type as t_type", "s_nodes as nodes", *[f"{q}_{c}" for q in "st" for c in ("x0", "y0", "x1", "y1")]).join(box, "page_num")
    d = d.selectExpr("page_num", "source", "target", "s_type", "t_type", "nodes", "glyph_count", "vector_count", "gw", "gh", f"{page_distance('s_', 't_')} / greatest(gw, gh, 1.0D) as distance")
    w = d.selectExpr("*", *[f"{sql} as {name}" for name, sql in _STATS.items()])
    # a node's degrees are looked up in its page's, so that pairs stay where they are
    counted = lambda side, name: p.groupBy("s_page_num", f"{side}_node_id").agg(F.count("*").alias("n")).groupBy(F.col("s_page_num").alias("page_num")).agg(F.map_from_entries(F.collect_list(F.struct(f"{side}_node_id", "n"))).alias(name))
    ends, starts = counted("s", "outs"), counted("t", "ins")
    w = w.join(ends, "page_num").join(starts, "page_num").selectExpr("*", "coalesce(try_element_at(ins, source), 0) as source_in", "coalesce(try_element_at(outs, target), 0) as target_out").drop("ins", "outs")
    large = graph_distances(seen.where(f"nodes > {pairs.ALL}").select("page_num", "node_id", "node_type", "x0", "y0", "x1", "y1"), degrees=True)
    x = w.unionByName(large.selectExpr("*", *[f"{sql} as {name}" for name, sql in _STATS.items()]))
    return x.selectExpr("source", "target", *[f"round(cast({sql} as double), 6) as {name}" for name, sql in _GRAPH_FEATURES.items()])


@query("g05_training_hints", f"with {GLYPHS}, h as (select {G.relation_hint('s.', 't.')} as hint, {G.relation_hint('s.', 't.', scripts_first=True)} as training_hint from glyphs s join glyphs t on s.page_num = t.page_num and s.node_id <> t.node_id) select coalesce(hint, '') as hint, coalesce(training_hint, '') as training_hint, count(*) as n from h group by all")
def g05(spark, sf_dir):
    """Hints of pairs by the rules of features and by those of training data, where scripts come before neighbours."""
    from foliogrid.plans.base import glyphs

    p = pairs.local_pairs(glyphs(spark, sf_dir)).selectExpr(f"coalesce({G.relation_hint('s_', 't_')}, '') as hint", f"coalesce({G.relation_hint('s_', 't_', scripts_first=True)}, '') as training_hint")
    return p.groupBy("hint", "training_hint").agg(F.count("*").alias("n"))
