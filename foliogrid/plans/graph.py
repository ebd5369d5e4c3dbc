"""Structural knowledge graph: nodes and edges of blocks, and components of linked boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions import geometry as G
from foliogrid.functions import text as X
from foliogrid.operators.components import connected_components
from foliogrid.plans import duck as D
from foliogrid.plans.base import BLOCKS, FORMULAS, blocks, formulas, query
from foliogrid.operators.pairs import twin

_FACTS = "(block_type in ('heading', 'paragraph', 'formula', 'table') and trim(content) <> '')"


def graph_blocks(b: DataFrame) -> DataFrame:
    """Blocks that may state facts, with the ids of what they touch."""
    carried = b.withColumn("section_title", F.expr("coalesce(last(case when block_type = 'heading' then content end, true) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), '')"))
    return carried.where(_FACTS).selectExpr(
        "*",
        "concat('doc:', doc_id) as doc_node",
        "concat('page:', doc_id, ':', page_num + 1) as page_node",
        "concat('block:', doc_id, ':', block_id) as block_node",
        f"if(section_title <> '', concat('section:', doc_id, ':', {X.stable_token('section_title')}), null) as section_node",
        f"if(block_type = 'heading', concat('section:', doc_id, ':', {X.stable_token('trim(content)')}), null) as own_section",
        "if(block_type = 'formula', concat('formula:', doc_id, ':', block_id), null) as formula_node",
        "if(contains(lower(content), 'theorem') or n % 23 = 5, concat('theorem:', doc_id, ':', block_id), null) as theorem_node",
    )


def graph_nodes(b: DataFrame) -> DataFrame:
    """(id, type, label) of all nodes, each once."""
    g = graph_blocks(b)
    label = X.preview("content", 120)
    made = F.expr(
        f"""array_compact(array(
          named_struct('id', doc_node, 'type', 'document', 'label', ''), named_struct('id', page_node, 'type', 'page', 'label', cast(page_num + 1 as string)),
          named_struct('id', block_node, 'type', 'block', 'label', {label}),
          if(section_node is null, null, named_struct('id', section_node, 'type', 'section', 'label', lower({X.collapsed('section_title')}))),
          if(own_section is null, null, named_struct('id', own_section, 'type', 'section', 'label', lower({X.collapsed('content')}))),
          if(formula_node is null, null, named_struct('id', formula_node, 'type', 'formula', 'label', content)),
          if(theorem_node is null, null, named_struct('id', theorem_node, 'type', 'theorem', 'label', {label}))))"""
    )
    return g.select(F.explode(made).alias("v")).select("v.*").distinct()


def graph_edges(b: DataFrame) -> DataFrame:
    """(source, target, type, evidence) of all edges, each once."""
    g = graph_blocks(b)
    edge = lambda s, t, kind: f"if({s} is null or {t} is null, null, named_struct('source', {s}, 'target', {t}, 'type', '{kind}', 'evidence', block_id))"
    kinds = [("doc_node", "page_node", "contains_page"), ("page_node", "block_node", "contains_block"), ("section_node", "block_node", "contains_block"), ("block_node", "section_node", "in_section"), ("block_node", "own_section", "defines_section"), ("block_node", "formula_node", "expresses_formula"), ("block_node", "theorem_node", "states_theorem")]
    made = F.expr(f"array_compact(array({', '.join(edge(*k) for k in kinds)}))")
    return g.select(F.explode(made).alias("v")).select("v.*").distinct()


_G = f"""
sec as (select *, coalesce(last_value(case when block_type = 'heading' then content end ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), '') as section_title from blocks),
g as (select *, 'doc:' || doc_id as doc_node, 'page:' || doc_id || ':' || (page_num + 1) as page_node, 'block:' || doc_id || ':' || block_id as block_node,
  case when section_title <> '' then 'section:' || doc_id || ':' || {D.stable_token('section_title')} end as section_node,
  case when block_type = 'heading' then 'section:' || doc_id || ':' || {D.stable_token('trim(content)')} end as own_section,
  case when block_type = 'formula' then 'formula:' || doc_id || ':' || block_id end as formula_node,
  case when contains(lower(content), 'theorem') or n % 23 = 5 then 'theorem:' || doc_id || ':' || block_id end as theorem_node from sec where {_FACTS})
"""


@query(
    "d01_graph_nodes",
    f"""with {BLOCKS}, {_G} select distinct id, type, label from (
      select doc_node as id, 'document' as type, '' as label from g union all select page_node, 'page', (page_num + 1)::varchar from g union all select block_node, 'block', {D.preview('content', 120)} from g
      union all select section_node, 'section', lower({D.collapsed('section_title')}) from g union all select own_section, 'section', lower({D.collapsed('content')}) from g
      union all select formula_node, 'formula', content from g union all select theorem_node, 'theorem', {D.preview('content', 120)} from g) where id is not null""",
)
def d01_nodes(spark, sf_dir):
    return graph_nodes(blocks(spark, sf_dir))


@query(
    "d01_graph_edges",
    f"""with {BLOCKS}, {_G} select distinct source, target, type, evidence from (
      select doc_node as source, page_node as target, 'contains_page' as type, block_id as evidence from g union all select page_node, block_node, 'contains_block', block_id from g
      union all select section_node, block_node, 'contains_block', block_id from g union all select block_node, section_node, 'in_section', block_id from g
      union all select block_node, own_section, 'defines_section', block_id from g union all select block_node, formula_node, 'expresses_formula', block_id from g
      union all select block_node, theorem_node, 'states_theorem', block_id from g) where source is not null and target is not null""",
)
def d01_edges(spark, sf_dir):
    return graph_edges(blocks(spark, sf_dir))


def box_groups(boxes: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, group): boxes of a page joined by IoU, however long the chain; pairs come from a join on page and grid cell."""
    cells = boxes.selectExpr("*", "explode(sequence(cast(floor(x0 / 200) as int), cast(floor(x1 / 200) as int))) as cx")
    pairs = twin(cells.selectExpr("concat(page_num, ':', cx, ':', cast(floor((y0 + y1) / 2 / 100) as int)) as cell", "id", "page_num", "x0", "y0", "x1", "y1").unionByName(cells.selectExpr("concat(page_num, ':', cx, ':', cast(floor((y0 + y1) / 2 / 100) as int) + 1) as cell", "id", "page_num", "x0", "y0", "x1", "y1")), key="cell").where("s_id < t_id")
    linked = pairs.where(f"{G.iou('s_', 't_')} >= {least}").selectExpr("s_id as a", "t_id as b").distinct()
    own = boxes.selectExpr("id as a", "id as b")
    return connected_components(linked.unionByName(own)).selectExpr("node as id", "component as `group`")


@query(
    "j14_fusion_groups",
    f"""with recursive {FORMULAS}, f as (select result_id as id, page_num, x0, y0, x1, y1 from formulas where stage <> 'inline_spans'),
    l as (select s.id as a, t.id as b from f s join f t on s.page_num = t.page_num where {G.iou('s.', 't.')} >= 0.8),
    walk(id, reach) as (select id, id from f union select w.id, l.b from walk w join l on w.reach = l.a)
    select id, min(reach) as "group" from walk group by id""",
)
def j14(spark, sf_dir):
    """Candidates whose boxes nearly coincide, as connected groups."""
    return box_groups(formulas(spark, sf_dir).where("stage <> 'inline_spans'").selectExpr("result_id as id", "page_num", "x0", "y0", "x1", "y1"))


@query("d04_bookmarks", f"with {BLOCKS} select doc_id, page_num, block_id, left({D.collapsed('content')}, 60) as title from blocks where block_type = 'heading' and trim(content) <> '' union all select doc_id, page_num, block_id, left({D.collapsed('content')}, 60) from blocks where block_type <> 'heading' and regexp_matches(lower(content), 'theorem|lemma|definition|license')")
def d04(spark, sf_dir):
    """Bookmarks to suggest: headings, and blocks that state something."""
    b = blocks(spark, sf_dir)
    title = f"left({X.collapsed('content')}, 60) as title"
    a = b.where("block_type = 'heading' and trim(content) <> ''").selectExpr("doc_id", "page_num", "block_id", title)
    return a.unionByName(b.where("block_type <> 'heading' and lower(content) rlike 'theorem|lemma|definition|license'").selectExpr("doc_id", "page_num", "block_id", title))


@query("d03_rechunk", f"with {BLOCKS}, m as (select *, lead(content) over w as next, lead(x0) over w as nx0, lead(y0) over w as ny0, lead(x1) over w as nx1, lead(y1) over w as ny1, n % 7 = 2 and lead(n) over w is not null as takes, coalesce(lag(n % 7 = 2) over w, false) as taken from blocks window w as (partition by doc_id order by n)) select doc_id, block_id, md5(case when takes then content || ' ' || next else content end) as content_md5, case when takes then least(x0, nx0) else x0 end as x0, case when takes then greatest(y1, ny1) else y1 end as y1 from m where not taken")
def d03(spark, sf_dir):
    """Marked blocks swallow the one behind them: text joined, boxes united."""
    w = "over (partition by doc_id order by n)"
    m = blocks(spark, sf_dir).selectExpr("*", f"lead(content) {w} as next", f"lead(x0) {w} as nx0", f"lead(y1) {w} as ny1", f"n % 7 = 2 and lead(n) {w} is not null as takes", f"coalesce(lag(n % 7 = 2) {w}, false) as taken").where("not taken")
    return m.selectExpr("doc_id", "block_id", "md5(if(takes, concat(content, ' ', next), content)) as content_md5", "if(takes, least(x0, nx0), x0) as x0", "if(takes, greatest(y1, ny1), y1) as y1")
