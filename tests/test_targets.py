"""Target trees from parse trees, and what a parser is taught by them."""

import json

import pytest

from foliogrid.operators import supervision as S
from foliogrid.operators import targets as T


def sym(c, kind="mathord"):
    return {"type": kind, "text": c}


def group(*xs):
    return {"type": "ordgroup", "body": list(xs)}


def shape(tree):
    """A tree as nested (kind, value, {relation: [children]})."""
    nodes = {n[0]: n for n in tree["nodes"]}

    def walk(name):
        _, kind, value, _, _ = nodes[name]
        below = sorted((o, r, t) for s, t, r, o in tree["edges"] if s == name)
        return (kind, value, [(r, walk(t)) for _, r, t in below])

    return walk(tree["root"])


def leaf(c):
    return ("symbol", c, [])


@pytest.mark.parametrize(
    "ast,want",
    [
        ([sym("x")], ("group", "", [("child", leaf("x"))])),
        ([{"type": "genfrac", "numer": sym("a"), "denom": sym("b")}], ("group", "", [("child", ("fraction", "", [("numerator", leaf("a")), ("denominator", leaf("b"))]))])),
        ([{"type": "supsub", "base": sym("x"), "sub": sym("i"), "sup": sym("2")}], ("group", "", [("child", ("script", "", [("base", leaf("x")), ("sub", leaf("i")), ("sup", leaf("2"))]))])),
        ([{"type": "supsub", "base": {"type": "op", "limits": True, "symbol": True, "name": "∑"}, "sub": sym("i")}], ("group", "", [("child", ("under_over", "", [("base", leaf("∑")), ("under", leaf("i"))]))])),
        ([{"type": "sqrt", "index": sym("3"), "body": sym("x")}], ("group", "", [("child", ("radical", "", [("radical_index", leaf("3")), ("radical_body", leaf("x"))]))])),
        ([{"type": "supsub", "base": group(), "sup": sym("a")}, sym("X")], ("group", "", [("child", ("script", "", [("pre_sup", leaf("a")), ("base", leaf("X"))]))])),
        ([{"type": "op", "name": "\\sin"}], ("group", "", [("child", ("text_run", "sin", []))])),
        ([{"type": "text", "body": [sym("i", "textord"), sym("f", "textord")]}], ("group", "", [("child", ("text_run", "if", []))])),
        ([{"type": "leftright", "left": "(", "right": ")", "body": [sym("x")]}], ("group", "", [("child", ("fence", "", [("fence_open", leaf("(")), ("fence_body", ("group", "", [("child", leaf("x"))])), ("fence_close", leaf(")"))]))])),
        ([sym("a"), {"type": "cr"}, sym("b")], ("matrix", "", [("matrix_row", ("group", "", [("matrix_cell", ("group", "", [("cell_content", ("group", "", [("child", leaf("a"))]))]))])), ("matrix_row", ("group", "", [("matrix_cell", ("group", "", [("cell_content", ("group", "", [("child", leaf("b"))]))]))]))])),
        ([{"type": "overline", "body": sym("x")}], ("group", "", [("child", ("accent", "\\overline", [("accent_base", leaf("x"))]))])),
        ([{"type": "kern"}, {"type": "phantom", "body": [sym("x")]}], ("group", "", [("child", ("artifact", "", [])), ("child", ("group", "", [("child", ("artifact", "", [])), ("child", ("group", "", [("child", leaf("x"))]))]))])),
        ([{"type": "xArrow", "label": "\\to", "body": sym("f")}], ("group", "", [("child", ("under_over", "", [("base", leaf("\\to")), ("over", leaf("f"))]))])),
        ([{"type": "mathchoice", "text": [sym("t")], "display": [sym("d")]}], ("group", "", [("child", ("group", "", [("child", leaf("t"))]))])),
    ],
)
def test_shapes(ast, want):
    tree = T.build(ast)
    assert shape(tree) == want and tree["warnings"] == []


def test_matrices_tags_and_aliases():
    tree = T.build([{"type": "array", "body": [[sym("a"), sym("b")], [sym("c")]], "tags": [[sym("1", "textord")], []], "colSeparationType": "align"}])
    kinds = [n[1] for n in tree["nodes"]]
    assert kinds.count("equation_number") == 1 and [n[4].get("environment") for n in tree["nodes"] if n[1] == "matrix"] == ["aligned"]
    assert {"matrix_grid", "aligned_display", "equation_tag", "sequence"} <= set(T.tree_tags(tree))
    tree = T.build([sym("\\alpha"), sym("x")], "<math><semantics><mi>α</mi><mi>x</mi><annotation>no</annotation></semantics></math>")
    assert [n[4]["identity_aliases"] for n in tree["nodes"] if n[1] == "symbol"] == [["α"], []]
    assert T.build(None) is None and T.build([]) is None and T.presentation_text("<broken") == ""
    types, tags = T.counts([{"type": "sqrt", "body": sym("x")}], "<math><mi>x</mi></math>")
    assert types == {"sqrt": 1, "mathord": 1} and tags == {"math": 1, "mi": 1}


@pytest.mark.parametrize(
    "ast,warning",
    [
        ([{"type": "new", "body": [sym("x")]}], "target_tree_unsupported_katex_type:new"),
        ([{}], "target_tree_unsupported_katex_type:missing"),
        (["x"], "target_tree_non_object_node"),
        ([{"type": "supsub", "sup": sym("2")}], "target_tree_script_missing_base"),
        ([{"type": "genfrac", "numer": sym("a")}], "target_tree_fraction_missing_denominator"),
        ([{"type": "sqrt"}], "target_tree_radical_missing_body"),
        ([{"type": "color", "color": "#cc0000", "body": []}], "target_tree_katex_error_color_node"),
        ([{"type": "horizBrace"}], "target_tree_horiz_brace_missing_base"),
        ([{"type": "enclose"}], "target_tree_enclosure_missing_body"),
        ([{"type": "operatorname", "body": []}], "target_tree_operatorname_empty_body"),
    ],
)
def test_warnings(ast, warning):
    assert warning in T.build(ast)["warnings"]


def test_symbol_keys():
    same = lambda a, b: bool(T.symbol_keys(a) & T.symbol_keys(b))
    assert same("Ａ", "a") and same("∑", "\\sum") and same("ﬁ", "FI") and same("²", "2") and not same("x", "y") and not same("", "")


def item(name, text, x, y, w=6, h=8, rule=False):
    return S.Item(name, text, "", (x, y, x + w, y + h), rule)


def test_fractions_are_aligned_and_taught():
    tree = T.build([{"type": "genfrac", "numer": group(sym("a"), sym("b")), "denom": sym("c")}])
    s = S.Supervision(tree, [item("g0", "a", 2, 0), item("g1", "b", 9, 0), item("g2", "c", 5, 14), item("v0", "", 0, 10, 18, 1, True)])
    # glyphs are met from left to right, so c between a and b is skipped and never met again
    assert [(m.glyph, m.confidence) for m in s.matches] == [("g0", 1.0), ("g1", 0.98)]
    s = S.Supervision(tree, [item("g0", "a", 2, 0), item("g1", "b", 9, 0), item("g2", "c", 10, 14), item("v0", "", 0, 10, 18, 1, True)])
    assert [m.glyph for m in s.matches] == ["g0", "g1", "g2"] and s.warnings() == []
    taught = {k: r for k, (r, _) in s.taught().items()}
    assert taught[("v0", "v0")] == "FRACTION_BAR" and taught[("v0", "g0")] == "ABOVE" and taught[("v0", "g2")] == "BELOW" and taught[("g0", "g1")] == "NEXT"
    roles = {x.role for x in s.structures()}
    assert {"FRACTION_SEPARATOR", "FRACTION_GROUP_BOUNDARY", "GROUP_BOUNDARY", "VECTOR_ROLE"} <= roles
    assert any(x.role == "VECTOR_ROLE" and x.detail.startswith("FRACTION_BAR") for x in s.structures())
    assert {(g, label) for g, label, _ in s.node_samples()} == {("g0", "SYMBOL"), ("g1", "SYMBOL"), ("g2", "SYMBOL"), ("v0", "HORIZONTAL_RULE")}


@pytest.mark.parametrize(
    "ast,items,want",
    [
        ([{"type": "sqrt", "index": sym("3"), "body": sym("x")}], [item("g0", "√", 0, 0), item("g1", "3", 1, -4), item("g2", "x", 9, 0)], {("g0", "g2"): "RADICAL_BODY", ("g0", "g1"): "RADICAL_INDEX"}),
        ([{"type": "supsub", "base": sym("x"), "sub": sym("i"), "sup": sym("2")}], [item("g0", "x", 0, 0), item("g1", "i", 7, 6), item("g2", "2", 8, -3)], {("g0", "g1"): "SUB", ("g0", "g2"): "SUP"}),
        ([{"type": "supsub", "base": {"type": "op", "limits": True, "symbol": True, "name": "∑"}, "sub": sym("i"), "sup": sym("n")}], [item("g0", "∑", 0, 4), item("g1", "i", 2, 14), item("g2", "n", 3, 0)], {("g0", "g1"): "UNDER", ("g0", "g2"): "OVER"}),
        ([{"type": "leftright", "left": "(", "right": ")", "body": [sym("x")]}], [item("g0", "(", 0, 0), item("g1", "x", 7, 0), item("g2", ")", 14, 0)], {("g1", "g0"): "FENCE_OPEN", ("g1", "g2"): "FENCE_CLOSE", ("g0", "g1"): "FENCE_BODY", ("g2", "g1"): "FENCE_BODY"}),
        ([{"type": "array", "body": [[sym("a"), sym("b")], [sym("c"), sym("d")]]}], [item("g0", "a", 0, 0), item("g1", "b", 10, 0), item("g2", "c", 20, 12), item("g3", "d", 30, 12)], {("g0", "g1"): "MATRIX_CELL", ("g2", "g3"): "MATRIX_CELL", ("g0", "g2"): "MATRIX_ROW"}),
        ([{"type": "text", "body": [sym("i", "textord"), sym("f", "textord")]}], [item("g0", "i", 0, 0), item("g1", "f", 7, 0)], {("g0", "g1"): "TEXT_RUN_NEXT"}),
        ([{"type": "overline", "body": sym("x")}], [item("g0", "x", 0, 3), item("v0", "", 0, 0, 7, 1, True)], {("v0", "v0"): "OVERLINE", ("v0", "g0"): "BELOW"}),
        ([{"type": "supsub", "base": group(), "sup": sym("a"), "sub": sym("b")}, sym("X")], [item("g0", "a", 0, 0, 3, 4), item("g1", "b", 1, 8, 3, 4), item("g2", "X", 6, 2)], {("g2", "g0"): "PRE_SUP", ("g2", "g1"): "PRE_SUB"}),
        ([{"type": "array", "body": [[sym("a")]], "tags": [[{"type": "text", "body": [sym("1", "textord")]}]]}], [item("g0", "a", 0, 0), item("g1", "1", 90, 0)], {("g0", "g1"): "EQUATION_TAG"}),
        ([{"type": "enclose", "label": "\\fbox", "body": sym("x")}], [item("g0", "x", 4, 4), item("v0", "", 0, 2, 14, 1, True)], {("v0", "g0"): "ENCLOSURE_BODY"}),
    ],
)
def test_relations_that_structures_teach(ast, items, want):
    taught = {k: r for k, (r, _) in S.Supervision(T.build(ast), items).taught().items()}
    assert {k: taught.get(k) for k in want} == want, taught


def test_what_matches_nothing():
    s = S.Supervision(T.build([sym("x"), sym("y")]), [item("g0", " ", 0, 0), item("g1", "q", 7, 0), item("g2", "|", 14, 0)])
    assert s.matches == [] and [w for _, w in s.ignored()] == ["spacing_or_blank", "unmatched_pdf_node", "unmatched_punctuation_or_marker"]
    assert s.warnings() == ["alignment_no_leaf_matches", "alignment_low_hard_coverage", "alignment_unmatched_target_nodes"]
    assert [x[1] for x in s.node_samples()] == ["SPACING", "UNKNOWN", "UNKNOWN"] and s.taught() == {}
    assert S.match_score("abc", "ab", "") == 0.72 and S.match_score("a", "ab", "") == 0.68 and S.match_score("", "a", "") == 0


def test_frames(spark):
    rows = [(1, json.dumps([sym("x"), sym("y")]), ""), (2, "{broken", ""), (3, None, None)]
    df = spark.createDataFrame(rows, "row_id long, ast string, mathml string")
    items = "array(named_struct('id', 'g0', 'text', 'x', 'latex', '', 'x0', 0D, 'y0', 0D, 'x1', 5D, 'y1', 5D, 'rule', false))"
    got = S.labelled(df.select("row_id", T.trees_of("ast", "mathml").alias("tree")).selectExpr("*", f"{items} as items")).collect()
    assert {r.role for r in got if r.kind == "warning" and r.row_id > 1} == {"missing_target_tree"} and [r.source for r in got if r.kind == "match"] == ["g0"]
