"""Layout trees as LaTeX: nodes and edges of a formula, written by templates from the leaves up."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a node of a kind is written. ``<r>`` is the first child by relation r; a part in ``(( ))`` stands only if its child is there.
TEMPLATES = {
    "fraction": r"\frac{<numerator>}{<denominator>}",
    "radical": r"\sqrt(([<radical_index>])){<radical_body>}",
    "script": "((_{<pre_sub>}))((^{<pre_sup>}))<base>((_{<sub>}))((^{<sup>}))",
    "under_over": "<base>((_{<under>}))((^{<over>}))",
    "fence": "<fence_open><fence_body><fence_close>",
}
SEQUENCES = {"group": ("child", "next", "cell_content")}
_PART = re.compile(r"\(\((.*?)\)\)")
_CHILD = re.compile(r"<(\w+)>")

Node = tuple[str, str, str, str]  # id, kind, value, latex
Edge = tuple[str, str, str, int]  # source, target, relation, order


def to_latex(nodes: list[Node], edges: list[Edge], root: str, environment: str = "matrix") -> str:
    """The tree under ``root``. A node inside itself, or not there, is empty."""
    known = {n[0]: n for n in nodes}
    out: dict[str, list[tuple[int, str, str]]] = defaultdict(list)
    for s, t, relation, order in edges:
        out[s].append((order, relation, t))
    for own in out.values():
        own.sort()

    def children(node: str, *relations: str) -> list[str]:
        return [t for _, r, t in out[node] if r in relations]

    def fill(template: str, node: str, path: frozenset) -> str:
        """Piece by piece, so that what a child says is never read as a template."""
        first = lambda r: next((written(t, path) for t in children(node, r)), "")
        out = []
        for i, piece in enumerate(_PART.split(template)):
            names = _CHILD.findall(piece)
            values = {r: first(r) for r in names}
            if i % 2 == 0 or all(values.values()):
                out += [values[x] if j % 2 else x for j, x in enumerate(_CHILD.split(piece))]
        return "".join(out)

    def written(node: str, path: frozenset) -> str:
        if node in path or node not in known:
            return ""
        path = path | {node}
        _, kind, value, latex = known[node]
        if kind == "symbol":
            return latex or value
        if kind == "text_run":
            return "\\text{" + value.replace("\\", "\\textbackslash{}").replace("{", "\\{").replace("}", "\\}").replace("\\textbackslash\\{\\}", "\\textbackslash{}") + "}"
        if kind == "artifact":
            return ""
        if kind == "accent":
            return (latex or value or "\\hat") + "{" + fill("<accent_base>", node, path) + "}"
        if kind == "matrix":
            rows = ["&".join(written(c, path) for c in children(r, "matrix_cell")) for r in children(node, "matrix_row")]
            name = value or environment
            return f"\\begin{{{name}}}" + "\\\\".join(rows) + f"\\end{{{name}}}"
        if kind in TEMPLATES:
            empty = "{}" if kind == "script" and children(node, "pre_sub", "pre_sup") else ""
            return empty + fill(TEMPLATES[kind], node, path)
        return "".join(written(t, path) for t in children(node, *SEQUENCES.get(kind, ("child", "next"))))

    return written(root, frozenset())


def leaves(nodes: list[Node], edges: list[Edge], root: str) -> list[str]:
    """Ids of the leaves under ``root`` in order, each once."""
    out: dict[str, list[tuple[int, str, str]]] = defaultdict(list)
    for s, t, relation, order in edges:
        out[s].append((order, relation, t))
    seen, found, todo = set(), [], [root]
    kinds = {n[0]: n[1] for n in nodes}
    while todo:
        node = todo.pop()
        if node in seen or node not in kinds:
            continue
        seen.add(node)
        own = sorted(out[node])
        if not own and kinds[node] in ("symbol", "text_run"):
            found.append(node)
        todo += [t for _, _, t in reversed(own)]
    return found


TREE = "struct<root:string,nodes:array<struct<id:string,kind:string,value:string,latex:string>>,edges:array<struct<source:string,target:string,relation:string,ord:int>>>"


def latex_of(tree: str) -> Column:
    """``to_latex`` of a column of trees (see ``TREE``), by batches."""

    @F.pandas_udf("string")
    def run(trees: pd.DataFrame) -> pd.Series:
        return pd.Series([to_latex([(n["id"], n["kind"], n["value"] or "", n["latex"] or "") for n in t.nodes], [(e["source"], e["target"], e["relation"], e["ord"]) for e in t.edges], t.root) for t in trees.itertuples()])

    return run(tree)
