"""Formulas recognised from a page's glyphs: display regions and their LaTeX, relation graphs written and verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.operators import display, serialise
from foliogrid.plans.base import glyphs, query
from foliogrid.plans.glyphs import relation_edges
from foliogrid.plans.structures import RELATION_OF_HINT

PAGE_SIZE = (200.0, 260.0)


def set_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(glyphs, marks) of pages of six lines: an order is a line, a mark stands under some lines; places follow from keys."""
    g = glyphs(spark, sf_dir).withColumnRenamed("page_num", "key")
    lines = g.selectExpr(
        "key div 6 as page_num",
        "cast(key % 6 as int) as line",
        "idx",
        "if(text = '-' , '−', if(cid % 17 = 3, '√', text)) as text",
        "font",
        "if(cid % 5 = 0, size * 0.7D, size) as size",
        "x0 + key % 5 * 18 as x0",
        "y0 - 60 + key % 6 * 22 as y0",
        "x1 + key % 5 * 18 as x1",
        "y0 - 60 + key % 6 * 22 + (y1 - y0) * if(cid % 5 = 0, 0.7D, 1.0D) as y1",
    )
    marks = g.where("idx = 1 and key % 4 < 2").selectExpr("key div 6 as page_num", "x0 + key % 5 * 18 as x0", "y0 - 48 + key % 6 * 22 as y0", "x0 + key % 5 * 18 + 30 as x1", "y0 - 47 + key % 6 * 22 as y1")
    return lines, marks


@query("x01_display_regions")
def x01(spark, sf_dir):
    """Display formulas of each page: seeds, groups, parts, labels, and suppression of overlaps."""
    return display.display_regions(*set_pages(spark, sf_dir), ["page_num"], PAGE_SIZE).drop("latex", "latex_confidence", "latex_evidence", "warnings")


@query("x02_region_latex")
def x02(spark, sf_dir):
    """The regions' LaTeX: rows, scripts, roots, fractions and words."""
    return display.display_regions(*set_pages(spark, sf_dir), ["page_num"], PAGE_SIZE).select("page_num", "region", "latex", "latex_confidence", "latex_evidence", "warnings")


def _candidates(spark, sf_dir) -> DataFrame:
    g = glyphs(spark, sf_dir)
    nodes = g.selectExpr("page_num as row_id", "node_id as id", "'' as latex", "if(startswith(text, 'cid:'), '', text) as text", "x0 as x", "y0 as y", "false as rule", "if(cid % 10 = 0, 'TEXT', if(cid % 10 = 1, 'SPACING', 'SYMBOL')) as label", "0.5D + cid / 100 as sure")
    e = relation_edges(g).selectExpr("s_page_num as row_id", "s_node_id as source", "t_node_id as target", f"{RELATION_OF_HINT} as relation", "round(1 / (1 + abs(dx_over_height) + abs(dy_over_height)), 6) as confidence")
    return serialise.written_candidates(nodes, e.where("relation <> 'NONE'"))


@query("x12_graph_latex")
def x12(spark, sf_dir):
    """Relation graphs of the pages as LaTeX: the selected structure and what differs from it."""
    return _candidates(spark, sf_dir).select("row_id", "rank", "source", "latex", "confidence")


@query("x13_verified_candidates")
def x13(spark, sf_dir):
    """The candidates' layouts verified and ranked; one of each page is recommended for review, none is accepted."""
    return _candidates(spark, sf_dir).select("row_id", "rank", "status", "layout_confidence", "coverage", "warnings", "blockers", "score", "place", "recommended", F.lit(False).alias("accepted"))
