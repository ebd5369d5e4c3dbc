"""Queries whose steps depend on order: spans, placeholders, embeddings, suppression, clusters, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.operators import decode, latex, layout, parser, trees
from foliogrid.plans.base import formulas, glyphs, query
from foliogrid.plans.glyphs import relation_edges
from foliogrid.session import cut, table

#: A pair's hint as the relation that it suggests.
RELATION_OF_HINT = "case hint when 'right_neighbor' then 'NEXT' when 'superscript_zone' then 'SUP' when 'subscript_zone' then 'SUB' when 'above_zone' then 'OVER' when 'below_zone' then 'UNDER' else 'NONE' end"


def tex(spark, sf_dir):
    """Pages of TeX: the candidates of a page, each in delimiters that follow from its key."""
    wrapped = F.expr("element_at(array(concat('$', latex, '$'), concat('\\\\[', latex, '\\\\]'), concat('\\\\begin{align}', latex, '\\\\end{align}'), concat('% $', latex, '$\\n'), concat('text \\\\$5 ', '$$', latex, '$$')), cast(result_id % 5 + 1 as int))")
    f = formulas(spark, sf_dir).where("not contains(latex, '$')").select("candidate_id", F.struct("result_id", wrapped.alias("t")).alias("s"))
    return f.groupBy("candidate_id").agg(F.expr("array_join(transform(array_sort(collect_list(s)), x -> x.t), ' and ')").alias("text"))


@query("x03_latex_spans")
def x03(spark, sf_dir):
    """Spans of mathematics in TeX sources."""
    return latex.with_spans(tex(spark, sf_dir), "text").select("candidate_id", "span.kind", "span.delimiter", "span.start", "span.end", "span.body")


@query("f10_formula_shelter")
def f10(spark, sf_dir):
    """Formulas out of the way of a translation and back again."""
    s = tex(spark, sf_dir).withColumn("s", latex.sheltered("text"))
    return s.select("candidate_id", "text", "s.text", F.size("s.formulas").alias("n")).toDF("candidate_id", "text", "sheltered", "n").join(s.select(F.col("candidate_id").alias("c"), latex.restored("s.text", "s.formulas").alias("restored")), F.col("candidate_id") == F.col("c")).drop("c")


@query("f09_hashed_embeddings")
def f09(spark, sf_dir):
    """Hashed embeddings of the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select("item_id", latex.hashed_embedding("text").alias("embedding"))


@query("a38_suppressed_boxes")
def a38(spark, sf_dir):
    """Detected regions without the lower-scored ones that overlap them."""
    return layout.suppressed(formulas(spark, sf_dir).selectExpr("result_id as id", "page_num", "x0", "y0", "x1", "y1", "score"), ["page_num"])


@query("a15_evidence_clusters")
def a15(spark, sf_dir):
    """Glyphs of a page in clusters of neighbours."""
    return layout.clustered(glyphs(spark, sf_dir).selectExpr("node_id as id", "page_num", "x0", "y0", "x1", "y1"), ["page_num"])


@query("x11_decoded_structures")
def x11(spark, sf_dir):
    """Relation edges of each page decoded: selection, acyclic projection and beams, at most eight structures."""
    e = relation_edges(glyphs(spark, sf_dir)).selectExpr("s_page_num as row_id", "s_node_id as source", "t_node_id as target", f"{RELATION_OF_HINT} as relation", "round(1 / (1 + abs(dx_over_height) + abs(dy_over_height)), 6) as confidence")
    return decode.decode(e.where("relation <> 'NONE'"))


def _pairs(spark, sf_dir):
    """Candidate pairs with features; the hint that rules give plays the label."""
    return relation_edges(glyphs(spark, sf_dir)).selectExpr("edge_id as pair_id", "s_page_num as row_id", "s_node_id as source", "t_node_id as target", f"{RELATION_OF_HINT} as relation", "1.0D as weight", *parser.FEATURES)


@query("x08_parsed_relations")
def x08(spark, sf_dir):
    """Relations of all pairs by a network fitted on a sample, decoded into one agreeing structure for each page."""
    pairs = cut(_pairs(spark, sf_dir))  # made once for the sample and for all
    network = parser.fit(pairs)
    said = pairs.withColumn("p", parser.predicted(pairs, network)).selectExpr("row_id", "source", "target", "p.relation as relation", "bround(p.confidence, 4) as confidence")
    return decode.decode(said.where("relation <> 'NONE'"), best=1)


@query("a27_parser_metrics")
def parser_metrics(spark, sf_dir):
    """Precision and recall of that network by relation."""
    pairs = _pairs(spark, sf_dir)
    said = pairs.withColumn("p", parser.predicted(pairs, parser.fit(pairs))).selectExpr("relation as expected", "p.relation as predicted")
    c = said.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    return c.withColumn("support", F.expr("sum(n) over (partition by expected)")).withColumn("said", F.expr("sum(n) over (partition by predicted)")).where("expected = predicted").selectExpr("expected as relation", "n", "round(n / support, 3) as recall", "round(n / said, 3) as precision")


@query("x05_tree_latex")
def x05(spark, sf_dir):
    """Trees as LaTeX: a part's fraction over a script, built from its key."""
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """named_struct('root', 'f', 'nodes', array(
             named_struct('id', 'f', 'kind', 'fraction', 'value', '', 'latex', ''), named_struct('id', 's', 'kind', 'script', 'value', '', 'latex', ''),
             named_struct('id', 'x', 'kind', 'symbol', 'value', 'x', 'latex', ''), named_struct('id', 'n', 'kind', 'symbol', 'value', cast(p_size as string), 'latex', ''),
             named_struct('id', 't', 'kind', 'text_run', 'value', p_brand, 'latex', '')), 'edges', array(
             named_struct('source', 'f', 'target', 's', 'relation', 'numerator', 'ord', 0), named_struct('source', 'f', 'target', 't', 'relation', 'denominator', 'ord', 0),
             named_struct('source', 's', 'target', 'x', 'relation', 'base', 'ord', 0), named_struct('source', 's', 'target', 'n', 'relation', if(p_partkey % 2 = 0, 'sup', 'sub'), 'ord', 0))) as tree""",
    )
    return p.select("p_partkey", trees.latex_of("tree").alias("latex"))
