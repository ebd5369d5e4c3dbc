"""Target trees, their alignment with glyphs, and what a parser is taught; symbol keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.operators import supervision, targets
from foliogrid.plans.base import query
from foliogrid.session import table


def parsed_formulas(spark, sf_dir) -> DataFrame:
    """(row_id, ast, mathml, items): a part's formula as a parse tree, MathML and the glyphs and marks that it is set in, all from its key.

    One of seven shapes: a fraction, a root with a script, limits over a sum, brackets, a matrix, words, and an overlined letter.
    """
    sym = lambda c, kind="mathord": f"""concat('{{"type":"{kind}","text":"', {c}, '"}}')"""
    group = lambda *xs: f"""concat('{{"type":"ordgroup","body":[', concat_ws(',', {', '.join(xs)}), ']}}')"""
    part = lambda kind, **parts: "concat('{\"type\":\"" + kind + "\"'" + "".join(f""", ',"{k}":', {v}""" for k, v in parts.items()) + ", '}')"
    a, b, n = "substring('abcxyz', cast(p_partkey % 6 + 1 as int), 1)", "substring('klmnpq', cast(p_partkey div 7 % 6 + 1 as int), 1)", "cast(p_size % 10 as string)"
    shapes = [
        part("genfrac", numer=group(sym(a)), denom=group(sym(n, "textord"))),
        part("sqrt", body=group(part("supsub", base=sym(a), sup=group(sym(n, "textord"))))),
        part("supsub", base="'{\"type\":\"op\",\"symbol\":true,\"limits\":true,\"name\":\"∑\"}'", sub=group(sym(b)), sup=group(sym(n, "textord"))),
        part("leftright", left="'\"(\"'", right="'\")\"'", body=f"concat('[', {sym(a)}, ',', {sym(b)}, ']')"),
        part("array", body=f"concat('[[', {sym(a)}, ',', {sym(b)}, '],[', {sym(n, 'textord')}, ',', {sym(a)}, ']]')"),
        part("operatorname", body=f"concat('[', {sym(a)}, ',', {sym(b)}, ',', {sym(n, 'textord')}, ']')"),
        part("overline", body=sym(a)),
    ]
    glyph = lambda i, text, x, y, w=6, h=8: f"named_struct('id', 'g{i}', 'text', {text}, 'latex', '', 'x0', {x}D, 'y0', {y}D, 'x1', {x + w}D, 'y1', {y + h}D, 'rule', false)"
    mark = lambda x0, y0, x1, y1: f"named_struct('id', 'v0', 'text', '', 'latex', '', 'x0', {x0}D, 'y0', {y0}D, 'x1', {x1}D, 'y1', {y1}D, 'rule', true)"
    items = [
        [glyph(0, a, 2, 0), glyph(1, n, 2.5, 14), mark(0, 10, 12, 11)],
        [glyph(0, "'√'", 0, 0), glyph(1, a, 8, 2), glyph(2, n, 14, 0, 4, 5), mark(7, 0, 20, 1)],
        [glyph(0, "'∑'", 0, 6, 10, 12), glyph(1, b, 2, 20, 5, 6), glyph(2, n, 3, 0, 5, 6)],
        [glyph(0, "'('", 0, 0, 3), glyph(1, a, 4, 0), glyph(2, b, 11, 0), glyph(3, "')'", 18, 0, 3)],
        [glyph(0, a, 0, 0), glyph(1, b, 12, 0), glyph(2, n, 0.5, 12), glyph(3, a, 12.5, 12)],
        [glyph(0, a, 0, 0), glyph(1, b, 7, 0), glyph(2, n, 14, 0), glyph(3, "' '", 21, 0)],
        [glyph(0, a, 0, 3), mark(0, 0, 7, 1)],
    ]
    pick = lambda xs: f"element_at(array({', '.join(xs)}), cast(p_partkey % 7 + 1 as int))"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as row_id", f"concat('[', {pick(shapes)}, ']') as ast", f"concat('<math><mi>', {a}, '</mi></math>') as mathml", f"{pick([f'array({", ".join(x)})' for x in items])} as items")
    return p


def trees(spark, sf_dir) -> DataFrame:
    return parsed_formulas(spark, sf_dir).select("row_id", targets.trees_of("ast", "mathml").alias("tree"), "items")


@query("x04_target_trees")
def x04(spark, sf_dir):
    """Parse trees as target trees: nodes and edges in order, what they exercise (F39), and warnings."""
    node = "array_join(transform(tree.nodes, n -> concat_ws(':', n.id, n.kind, n.value, n.latex)), ';') as nodes"
    edge = "array_join(transform(tree.edges, e -> concat_ws(':', e.source, e.target, e.relation, e.ord)), ';') as edges"
    return trees(spark, sf_dir).selectExpr("row_id", "tree.root as root", node, edge, "array_join(tree.tags, ',') as tags", "array_join(tree.warnings, ',') as warnings")


@query("x07_alignment_labels")
def x07(spark, sf_dir):
    """Glyphs matched to trees, and the relation and structure labels that follow."""
    return supervision.labelled(trees(spark, sf_dir)).where("kind in ('match', 'relation', 'structure', 'ignored', 'warning')")


@query("x16_training_samples")
def x16(spark, sf_dir):
    """What a parser is taught of each formula's pairs and nodes."""
    return supervision.labelled(trees(spark, sf_dir)).where("kind in ('sample', 'node')").selectExpr("row_id", "kind", "role as label", "source", "target", "confidence")


@query("f24_symbol_keys")
def f24(spark, sf_dir):
    """Symbols that are the same but for spelling: width, case, presentation forms, commands."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "element_at(array('Ａ', 'ﬁ', '∑', '²', '×', 'x', 'Ω'), cast(p_partkey % 7 + 1 as int)) as a", "element_at(array('a', 'fi', '\\\\sum', '2', '\\\\times', 'y', 'Ω'), cast(p_partkey % 7 + 1 as int)) as b")
    return p.withColumn("same", targets.same_symbol("a", "b"))
