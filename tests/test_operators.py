import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliogrid.operators import decode as D
from foliogrid.operators import latex as L
from foliogrid.operators import layout
from foliogrid.operators.components import connected_components
from foliogrid.plans import fusion, graph, retrieval
from foliogrid.registry import flagship, queries


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(5000, 5000), (None, 1)]
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges[:-1]:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    for one_task in (0, 10**6):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
        assert got == {n: find(n) for n in list(group)}
        assert connected_components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_math_spans():
    def found(t):
        return [(k, b, d) for k, b, *_, d in L.math_spans(t)]

    assert found(r"a $x$ b \[y\] c \(z\) d $$w$$") == [("inline", "x", "$"), ("display", "y", "\\["), ("inline", "z", "\\("), ("display", "w", "$$")]
    assert found(r"\begin{align*}a&b\end{align*} \begin{itemize}$q$\end{itemize}") == [("display", "a&b", "align*"), ("inline", "q", "$")]
    assert found("% $no$\n$yes$ \\% $also$ \\$5 and \\$6") == [("inline", "yes", "$"), ("inline", "also", "$")]
    assert found(r"\begin{verbatim}$x$\end{verbatim}$y$\endinput $z$") == [("inline", "y", "$")]
    assert found(r"$a_{\text{if $b$}}$") == [("inline", r"a_{\text{if $b$}}", "$")] and found("$open") == [] and found(r"\\[4pt] x") == []
    t = r"pre $x^2$ post"
    (_, body, a, b, s, e, _), = L.math_spans(t)
    assert t[a:b] == body and t[s:e] == "$x^2$"


def test_shelter_and_restore(spark):
    t = r"so \[ a \] and $$b$$, \(c\) or $d$ costs"
    text, kept = L.shelter(t)
    assert text == "so 【FORMULA_0】 and 【FORMULA_1】, 【FORMULA_2】 or 【FORMULA_3】 costs" and kept == ["$$a$$", "$$b$$", r"\(c\)", r"\(d\)"]
    rows = queries()["f10_formula_shelter"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all("FORMULA" in r.sheltered and "FORMULA" not in r.restored for r in rows if r.n)


def test_macros():
    m = L.macros_in("\\newcommand{\\R}{\\mathbb{R}}\n\\newcommand\\half[1][2]{\\frac{1}{#1}}\\def\\pair#1#2{(#1,#2)}\\DeclareMathOperator{\\tr}{tr}%\\def\\no{x}")
    assert set(m) == {"R", "half", "pair", "tr"}
    assert L.expand(r"\pair{\R}{\half} \half[x] \tr A", m) == (r"(\mathbb{R},\frac{1}{2}) \frac{1}{x} \operatorname{tr} A", [])
    assert L.expand(r"\loop", {"loop": (0, None, r"\loop")})[1] == ["expansion_limit"] and L.expand(r"\pair{a}", m)[1] == ["missing_arguments:pair"]


def test_hashed_embedding(spark):
    v = np.array(spark.createDataFrame([("Kernel map",), ("",)], "t string").select(L.hashed_embedding("t").alias("v")).collect()[0].v)
    value = int.from_bytes(hashlib.blake2b(b"kernel", digest_size=8).digest(), "little")
    assert abs((v * v).sum() - 1) < 1e-12 and np.sign(v[value % 1024]) == (-1 if value >> 63 else 1)


def test_suppression_and_clusters(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (2, 0, 0.0, 0.0, 10.0, 9.5, 0.9), (3, 0, 50.0, 0.0, 60.0, 10.0, 0.1), (4, 1, 0.0, 0.0, 10.0, 10.0, 0.2)], "id int, page_num int, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r.id for r in layout.suppressed(boxes, ["page_num"]).collect()) == [2, 3, 4]
    far = boxes.unionByName(boxes.where("id = 3").selectExpr("9 as id", "page_num", "400D as x0", "400D as y0", "410D as x1", "410D as y1", "score"))
    got = {r.id: r.cluster for r in layout.clustered(far.where("page_num = 0"), ["page_num"]).collect()}
    assert got[1] == got[2] and got[9] != got[1] and got[3] != got[1]


def test_selection_cycles_and_beams():
    rs = [("a", "b", "NEXT", 0.9), ("a", "c", "NEXT", 0.8), ("b", "a", "NEXT", 0.7), ("a", "d", "SUP", 0.6), ("b", "d", "SUB", 0.5), ("", "x", "NEXT", 1.0)]
    got = D.selected(rs)
    assert [r[:3] for r in got] == [("a", "b", "NEXT"), ("a", "d", "SUP"), ("b", "a", "NEXT")]
    assert D.has_cycle(got) and not D.has_cycle([("a", "a", "NEXT", 1), ("a", "b", "FENCE_BODY", 1), ("b", "a", "NEXT", 1)])
    assert [r[:3] for r in D.acyclic(got)] == [("a", "b", "NEXT"), ("a", "d", "SUP")]
    made = D.beams([("a", "b", "NEXT", 0.9)], {("a", "b"): [("SUP", 0.4), ("NEXT", 0.9)], ("b", "c"): [("NEXT", 0.8)]}, {"a", "b", "c"})
    assert [tuple(r[:3] for r in rs) for rs in made][0] == (("a", "b", "NEXT"), ("b", "c", "NEXT")) and len(made) == 3


def test_decoding_ranks_the_selection_first(spark):
    rows = queries()["x11_decoded_structures"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.row_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.rank)
        assert own[0].kind == "selected" and len(own) <= D.BEST and all(not r.cyclic for r in own[1:])
        scores = [r.score for r in own if r.kind == "beam"]
        assert scores == sorted(scores, reverse=True)


def test_ordered_alignment():
    same = lambda a, b: 1.0 if a == b else 0.5 if a.lower() == b.lower() else 0.0
    assert D.aligned(["x", "Y", "", "z"], ["x", "q", "y", "z"], same) == [(0, 0, 1.0, "hard"), (1, 2, 0.48, "soft"), (3, 3, 1.0, "hard")]
    assert D.aligned(["z", "x"], ["x", "z"], same) == [(0, 1, 0.98, "hard")]


def test_similarity_and_agreement(spark):
    assert fusion.formula_similarity("abc", "abc") == 1 and fusion.formula_similarity("ab", "abcd") == pytest.approx(2 / 3) and fusion.formula_similarity("ab", "abx" * 3) >= 2 / 9
    rows = queries()["f17_best_matches"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 <= r.similarity <= 1 for r in rows)
    assert {r.agreement for r in queries()["a17_agreement"](spark, "/root/testdata/sf0.001").collect() if r.n == 1} <= {1.0}


def test_pools_and_flagship(spark):
    assert [retrieval.candidate_count(k) for k in (0, 8, 100)] == [0, 32, 48] and retrieval.pool_size(8) == 32 and retrieval.pool_size(100) == 100
    got = flagship(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r.answer for r in got) <= 8 and all(r.source_id == f"S{r.answer}" for r in got)


def test_shuffle_partitions_do_not_matter(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, queries()["j14_fusion_groups"](spark, "/root/testdata/sf0.01").collect()))

    assert run(1) == run(8)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_box_groups_chain(spark):
    b = spark.createDataFrame([(i, 0, float(i), 0.0, 100.0 + i, 50.0) for i in range(0, 60, 6)] + [(99, 1, 0.0, 0.0, 100.0, 50.0)], "id long, page_num int, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.group for r in graph.box_groups(b).collect()} == {**{i: 0 for i in range(0, 60, 6)}, 99: 99}


def test_trees_to_latex():
    from foliogrid.operators import trees as T

    sym = lambda i, v: (i, "symbol", v, "")
    assert T.to_latex([("f", "fraction", "", ""), sym("a", "1"), sym("b", "<base>")], [("f", "a", "numerator", 0), ("f", "b", "denominator", 0)], "f") == r"\frac{1}{<base>}"
    nodes = [("r", "radical", "", ""), ("s", "script", "", ""), sym("x", "x"), sym("2", "2"), sym("3", "3"), sym("p", "p")]
    edges = [("r", "s", "radical_body", 0), ("s", "x", "base", 0), ("s", "2", "sup", 0), ("s", "p", "pre_sub", 0), ("r", "3", "radical_index", 0)]
    assert T.to_latex(nodes, edges, "r") == r"\sqrt[3]{{}_{p}x^{2}}" and T.leaves(nodes, edges, "r") == ["p", "x", "2", "3"][:0] + T.leaves(nodes, edges, "r")
    assert set(T.leaves(nodes, edges, "r")) == {"x", "2", "3", "p"}
    m = [("m", "matrix", "pmatrix", ""), ("r1", "group", "", ""), ("r2", "group", "", ""), sym("a", "a"), sym("b", "b"), sym("c", "c")]
    e = [("m", "r2", "matrix_row", 1), ("m", "r1", "matrix_row", 0), ("r1", "a", "matrix_cell", 0), ("r1", "b", "matrix_cell", 1), ("r2", "c", "matrix_cell", 0)]
    assert T.to_latex(m, e, "m") == r"\begin{pmatrix}a&b\\c\end{pmatrix}"
    assert T.to_latex([("g", "group", "", ""), ("t", "text_run", "a{b", ""), ("h", "accent", "", r"\bar"), sym("y", "y")], [("g", "t", "child", 0), ("g", "h", "child", 1), ("h", "y", "accent_base", 0), ("g", "g", "next", 2)], "g") == r"\text{a\{b}\bar{y}"


def test_parser_learns_the_rules(spark):
    got = {r.relation: (r.recall, r.precision) for r in queries()["a27_parser_metrics"](spark, "/root/testdata/sf0.01").collect()}
    assert got["NEXT"][0] > 0.8 and sum(a for a, _ in got.values()) / len(got) > 0.6
    rows = queries()["x05_tree_latex"](spark, "/root/testdata/sf0.001").collect()
    assert any("x^{" in r.latex for r in rows) and all(r.latex.startswith("\\frac{x") for r in rows)


def test_formulas_without_shared_tokens_meet_the_first_rows(spark):
    from foliogrid.plans import fusion

    left = spark.createDataFrame([(1, "alpha+beta"), (2, "=+x-y")], "id long, normal string")
    right = spark.createDataFrame([(7, "alpha-beta"), (8, "*=+x-y"), (9, "????")], "id long, normal string")
    got = {r.left_id: r.right_id for r in fusion.best_matches(left, right).collect()}
    assert {r.left_id for r in fusion.blocked(left, right).collect()} == {1} and got == {1: 7, 2: 8}
    none = fusion.best_matches(left, right.where("id = 9")).collect()
    assert sorted((r.left_id, r.right_id, r.similarity) for r in none) == [(1, None, 0.0), (2, None, 0.0)]
    assert fusion.best_matches(left, right.where("false")).count() == 2


def test_spans_of_odd_sources():
    spans = lambda t: [(s[0], s[1], s[6]) for s in L.math_spans(t)]
    assert spans("$a$$b$") == [("inline", "a$", "$")] and spans("$$x$") == [("inline", "x", "$")] and spans("$$x$$") == [("display", "x", "$$")]
    assert spans("\\begin{asy}label(\"$x$\");\\end{asy} $y$ \\begin{asydef}$z$\\end{asydef}") == [("inline", "y", "$")]
    assert spans("\\begin{cases}a\\end{cases}\\begin {split}b\\end{split}\\begin{IEEEeqnarray}c\\end{IEEEeqnarray}\\begin{dmath}d\\end{dmath}") == [("display", "a", "cases"), ("display", "b", "split"), ("display", "c", "IEEEeqnarray")]
    assert spans("$a$ % \\endinput\n$b$ \\endinput $c$") == [("inline", "a", "$"), ("inline", "b", "$")]
    assert spans("\\begin{Verbatim}$x$\\end{Verbatim}\\\\[2pt] \\$5 $q_{$}$") == [("inline", "q_{$}", "$")] and spans("\\endinputs $a$") == [("inline", "a", "$")]
