"""Target trees: the parse tree of a formula's LaTeX as nodes and edges, with warnings, tags and identity keys.

The parse tree comes as JSON in a column (objects with ``type`` and parts such as ``body``, ``base``, ``sub``), as a LaTeX parser for the web gives
it. Nodes are numbered as they are met, so equal inputs give equal trees.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parse types that are symbols, those that mark operators, and layout that leaves a mark and its body.
SYMBOLS = "mathord textord atom op bin rel open close punct".split()
LAYOUT = "phantom hphantom vphantom smash lap".split()
#: Parts of plain structures: kind, then (key, relation, order, whether its absence is a warning), and the warning's name.
STRUCTURES = {
    "script": ("script", [("base", "base", 0, True), ("sub", "sub", 1, False), ("sup", "sup", 2, False)], "script"),
    "under_over": ("under_over", [("base", "base", 0, True), ("sub", "under", 1, False), ("sup", "over", 2, False)], "under_over"),
    "genfrac": ("fraction", [("numer", "numerator", 0, True), ("denom", "denominator", 1, True)], "fraction"),
    "accent": ("accent", [("base", "accent_base", 0, True)], "accent"),
    "horizBrace": ("accent", [("base", "accent_base", 0, True)], "horiz_brace"),
}
#: Which branch counts, in order, where a parser gives several.
BRANCHES = {"mathchoice": ("text", "display", "script", "scriptscript"), "htmlmathml": ("html", "mathml", "body")}
TEXT_KEYS, PART_KEYS = ("text", "name", "value", "delim"), ("body", "base", "sub", "sup", "numer", "denom", "index", "tags")
COUNTED = ("body", "base", "sub", "sup", "numer", "denom", "index", "above", "below", "tags")
#: Characters by their LaTeX, beyond what is written as it is.
LATEX = {"−": "-", "·": r"\cdot", "×": r"\times", "÷": r"\div", "±": r"\pm", "∈": r"\in", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "∼": r"\sim", "≅": r"\cong", "√": r"\sqrt", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∞": r"\infty", "∂": r"\partial", "∇": r"\nabla", "→": r"\to", "⊆": r"\subseteq", "⋆": r"\star", "Ω": r"\Omega", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "φ": r"\phi", "ω": r"\omega"}
ESCAPES = {"\\": r"\backslash{}", "{": r"\{", "}": r"\}", "_": r"\_", "^": r"\^{}", "#": r"\#", "$": r"\$", "%": r"\%", "&": r"\&"}


def latex_of(text: str) -> str:
    return text if text.startswith("\\") else "".join(LATEX.get(c, ESCAPES.get(c, c)) for c in text)


def symbol_keys(*values: str) -> set[str]:
    """What a symbol is known by: its compatibility form, that in lower case, and its LaTeX; two symbols are the same if they share a key."""
    out: set[str] = set()
    for value in values:
        plain = unicodedata.normalize("NFKC", (value or "").strip())
        if plain:
            command = unicodedata.normalize("NFKC", "".join(LATEX.get(c, ESCAPES.get(c, c)) for c in plain).strip())
            out |= {plain, plain.casefold(), command, command.casefold()}
    return out


def same_symbol(a: Column | str, b: Column | str) -> Column:
    """Whether two columns' symbols share a key."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(symbol_keys(p) & symbol_keys(q)) for p, q in zip(x, y, strict=True)], dtype=bool)

    return run(a, b)


def text_in(value: object) -> str:
    """All text of a part, depth first."""
    if isinstance(value, list):
        return "".join(map(text_in, value))
    if not isinstance(value, dict):
        return ""
    return _said(value) or "".join(text_in(value.get(k)) for k in PART_KEYS)


def _said(node: dict) -> str:
    for key in TEXT_KEYS:
        value = node.get(key, "")
        if isinstance(value, (int, float)) and not isinstance(value, bool) or (isinstance(value, str) and value):
            return str(value)
    return ""


def presentation_text(mathml: str) -> str:
    """The characters that MathML shows, without annotations."""

    def walk(node: ElementTree.Element) -> str:
        if node.tag.rsplit("}", 1)[-1] == "annotation":
            return ""
        return (node.text or "") + "".join(walk(c) + (c.tail or "") for c in node)

    root = _xml(mathml)
    return walk(root).strip() if root is not None else ""


def _xml(text: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(text) if (text or "").strip() else None
    except ElementTree.ParseError:
        return None


class _Tree:
    def __init__(self, shown: str):
        self.nodes: list[tuple[str, str, str, str, dict]] = []
        self.edges: list[tuple[str, str, str, int]] = []
        self.warnings: set[str] = set()
        self.shown, self.at = shown, 0

    def add(self, kind: str, value: str = "", latex: str = "", **attrs) -> str:
        name = f"n{len(self.nodes)}"
        self.nodes.append((name, kind, value, latex, attrs))
        return name

    def join(self, source: str, target: str, relation: str, order: int) -> None:
        if target:
            self.edges.append((source, target, relation, order))

    def warn(self, what: str) -> None:
        self.warnings.add(f"target_tree_{what}")

    def aliases(self, text: str) -> list[str]:
        """The shown characters that stand for a text: they are used up in order, one for a command, else as many as the text has."""
        n = 1 if text.startswith("\\") else len(text)
        alias = self.shown[self.at : self.at + n] if text else ""
        self.at += len(alias)
        return [alias] if alias and alias != text else []

    def symbol(self, text: str, **attrs) -> str:
        return self.add("symbol", text, latex_of(text), **attrs, identity_aliases=self.aliases(text))

    def sequence(self, parts: Iterable, role: str, **attrs) -> str:
        """A group of parts; line breaks make it rows, and scripts on nothing belong to what follows them."""
        parts = parts if isinstance(parts, list) else []
        if any(isinstance(p, dict) and p.get("type") == "cr" for p in parts):
            return self.rows(parts, role)
        root = self.add("group", role=role, **attrs)
        order = i = 0
        while i < len(parts):
            left = i + 1 < len(parts) and _hangs_left(parts[i])
            child = self.left(parts[i], parts[i + 1]) if left else self.node(parts[i])
            if child:
                self.join(root, child, "child", order)
                order += 1
            i += 2 if left else 1
        return root

    def each(self, root: str, body: object, missing: str = "") -> str:
        """The parts of a body below a node, as they are."""
        if not isinstance(body, (list, dict)):
            if missing:
                self.warn(missing)
            return root
        for i, part in enumerate(body if isinstance(body, list) else [body]):
            self.join(root, self.node(part), "child", i)
        return root

    def rows(self, parts: list, role: str) -> str:
        rows: list[list] = [[]]
        for p in parts:
            if isinstance(p, dict) and p.get("type") == "cr":
                rows.append([])
            else:
                rows[-1].append(p)
        rows = [r for r in rows if r]
        out = self.add("matrix", katex_type="cr_sequence", environment="aligned", display_container="aligned_display", group_role=role, row_count=len(rows))
        for i, row in enumerate(rows):
            line, cell = self.add("group", role="matrix_row", row=i), self.add("group", role="matrix_cell", row=i, column=0)
            content = self.sequence(row, "aligned_row")
            for edge in ((out, line, "matrix_row", i), (line, cell, "matrix_cell", 0), (cell, content, "cell_content", 0)):
                self.join(*edge)
        return out

    def left(self, script: dict, base: object) -> str:
        out = self.add("script", katex_type="supsub", placement="left_attachment")
        for order, (key, relation) in enumerate((("sup", "pre_sup"), ("sub", "pre_sub"))):
            if isinstance(script.get(key), dict):
                self.join(out, self.node(script[key]), relation, order)
        self.join(out, self.node(base), "base", 2)
        return out

    def structure(self, node: dict, rule: str, value: str = "", **attrs) -> str:
        kind, parts, name = STRUCTURES[rule]
        out = self.add(kind, value, value, **attrs)
        for key, relation, order, needed in parts:
            if isinstance(node.get(key), dict):
                self.join(out, self.node(node[key]), relation, order)
            elif needed:
                self.warn(f"{name}_missing_{'base' if key == 'base' else relation}")
        return out

    def node(self, node: object) -> str:
        if not isinstance(node, dict):
            self.warn("non_object_node")
            return self.add("artifact", reason="non_object_node")
        kind = str(node.get("type", "") or "")
        handler = getattr(self, f"on_{kind}", None) or (self.on_symbol if kind in SYMBOLS else self.on_layout if kind in LAYOUT else self.on_branch if kind in BRANCHES else self.on_other)
        return handler(node)

    def on_symbol(self, node: dict) -> str:
        kind, name, text = node["type"], str(node.get("name", "") or ""), _said(node)
        limits = {k: bool(node[s]) for k, s in (("limits", "limits"), ("always_handle_supsub", "alwaysHandleSupSub")) if s in node}
        if kind == "op" and not node.get("symbol") and len(name) > 1 and name[0] == "\\":
            self.aliases(name[1:].strip())
            return self.add("text_run", name[1:].strip(), katex_type="op", mode=str(node.get("mode", "") or ""), operator=True, source_operator_name=name, **limits)
        if kind == "op" and not text and isinstance(node.get("body"), list):
            return self.each(self.add("group", role="operator_body", katex_type="op", limits=bool(node.get("limits")), always_handle_supsub=bool(node.get("alwaysHandleSupSub"))), node["body"])
        family = {"family": str(node["family"])} if node.get("family") else {}
        return self.symbol(text, katex_type=kind, mode=str(node.get("mode", "") or ""), **family, **limits)

    def on_supsub(self, node: dict) -> str:
        base = node.get("base")
        above = isinstance(base, dict) and base.get("type") in ("op", "operatorname") and (base.get("limits") or base.get("alwaysHandleSupSub"))
        if above and any(isinstance(node.get(k), dict) for k in ("sub", "sup")):
            return self.structure(node, "under_over", katex_type="supsub", placement="limits", base_katex_type=base["type"])
        return self.structure(node, "script", katex_type="supsub")

    def on_ordgroup(self, node: dict) -> str:
        return self.sequence(node.get("body"), "ordgroup")

    def on_styling(self, node: dict) -> str:
        return self.sequence(node.get("body"), f"styling:{node.get('style', '')}")

    def on_sqrt(self, node: dict) -> str:
        out = self.add("radical", katex_type="sqrt")
        parts = [(k, r) for k, r in (("index", "radical_index"), ("body", "radical_body")) if isinstance(node.get(k), dict)]
        for order, (key, relation) in enumerate(parts):
            self.join(out, self.node(node[key]), relation, order)
        if not isinstance(node.get("body"), dict):
            self.warn("radical_missing_body")
        return out

    def on_genfrac(self, node: dict) -> str:
        more = {k: node[s] for s, k in (("leftDelim", "left_delimiter"), ("rightDelim", "right_delimiter"), ("size", "size"), ("continued", "continued"), ("barSize", "bar_size")) if node.get(s) is not None}
        return self.structure(node, "genfrac", katex_type="genfrac", has_bar_line=bool(node.get("hasBarLine", True)), **more)

    def on_text(self, node: dict) -> str:
        value = "".join(_said(x) for x in node.get("body") or [] if isinstance(x, dict))
        self.aliases(value)
        return self.add("text_run", value, katex_type="text", mode=str(node.get("mode", "") or ""))

    def on_operatorname(self, node: dict) -> str:
        value = text_in(node.get("body"))
        self.aliases(value)
        if not value:
            self.warn("operatorname_empty_body")
        return self.add("text_run", value, katex_type="operatorname", mode=str(node.get("mode", "") or ""), operator=True)

    def on_array(self, node: dict) -> str:
        rows = node.get("body") if isinstance(node.get("body"), list) else []
        apart = str(node.get("colSeparationType", "") or "")
        aligned = {"display_container": "aligned_display"} if apart == "align" else {}
        out = self.add("matrix", katex_type="array", environment="aligned" if aligned else "matrix", row_count=len(rows), column_count=max((len(r) for r in rows if isinstance(r, list)), default=0), col_separation=apart, **aligned)
        for i, row in enumerate(rows):
            line = self.add("group", role="matrix_row", row=i)
            self.join(out, line, "matrix_row", i)
            for j, cell in enumerate(row if isinstance(row, list) else []):
                held = self.add("group", role="matrix_cell", row=i, column=j)
                self.join(line, held, "matrix_cell", j)
                self.join(held, self.node(cell), "cell_content", 0)
        tags = [t for part in (node.get("tags") if isinstance(node.get("tags"), list) else []) for t in (part if isinstance(part, list) else [])]
        for k, tag in enumerate(tags):
            if text_in(tag):
                self.join(out, self.add("equation_number", text_in(tag), katex_type="tag", tag_index=k), "child", len(rows) + k)
        return out

    def on_color(self, node: dict) -> str:
        color = str(node.get("color", "") or "")
        if color.lower() == "#cc0000":  # how the parser paints what it can't read
            self.warn("katex_error_color_node")
            return self.add("artifact", reason="katex_error_color", katex_type="color")
        return self.each(self.add("group", role="color", katex_type="color", color=color), node.get("body"), "color_missing_body")

    def on_font(self, node: dict) -> str:
        font, body = str(node.get("font", "") or ""), node.get("body")
        if isinstance(body, list):
            return self.sequence(body, f"font:{font}")
        if not isinstance(body, dict):
            self.warn("font_missing_body")
            return self.add("artifact", reason="font_missing_body", katex_type="font", font=font)
        child = self.node(body)
        out = self.add("group", role=f"font:{font}", font=font, katex_type="font")
        self.join(out, child, "child", 0)
        return out

    def on_mclass(self, node: dict) -> str:
        own = str(node.get("mclass", "") or "")
        return self.each(self.add("group", role=f"mclass:{own}", katex_type="mclass", **({"atom_class": own} if own else {})), node.get("body"), "mclass_missing_body")

    def on_branch(self, node: dict) -> str:
        kind = node["type"]
        name = next((k for k in BRANCHES[kind] if isinstance(node.get(k), list) and node[k]), "")
        if not name:
            return self.add("artifact", reason=f"empty_{kind}", katex_type=kind)
        shown = {"mathml_text": t} if kind == "htmlmathml" and (t := text_in(node.get("mathml"))) else {}
        return self.each(self.add("group", role=kind, katex_type=kind, selected_branch=name, **shown), node[name])

    def on_leftright(self, node: dict) -> str:
        out = self.add("fence", katex_type="leftright")
        left, right = str(node.get("left", "") or ""), str(node.get("right", "") or "")
        if left:
            self.join(out, self.symbol(left), "fence_open", 0)
        self.join(out, self.sequence(node.get("body"), "fence_body"), "fence_body", 1)
        if right:
            self.join(out, self.symbol(right), "fence_close", 2)
        return out

    def on_accent(self, node: dict) -> str:
        return self.structure(node, "accent", str(node.get("label", "") or r"\hat"), katex_type="accent")

    def on_horizBrace(self, node: dict) -> str:
        over = bool(node.get("isOver"))
        return self.structure(node, "horizBrace", str(node.get("label", "") or (r"\overbrace" if over else r"\underbrace")), katex_type="horizBrace", annotation_position="over" if over else "under")

    def on_overline(self, node: dict) -> str:
        kind = node["type"]
        out = self.add("accent", f"\\{kind}", f"\\{kind}", katex_type=kind, annotation_position=kind.removesuffix("line"))
        body = node.get("body")
        if isinstance(body, (dict, list)):
            self.join(out, self.node(body) if isinstance(body, dict) else self.sequence(body, f"{kind}_body"), "accent_base", 0)
        else:
            self.warn(f"{kind}_missing_body")
        return out

    on_underline = on_overline

    def on_xArrow(self, node: dict) -> str:
        label = str(node.get("label", "") or "")
        out = self.add("under_over", katex_type="xArrow", label=label, placement="arrow_annotation")
        base = self.add("symbol", label, label, katex_type="xArrow", operator=True, identity_aliases=self.aliases(label))
        self.join(out, base, "base", 0)
        for order, (key, relation) in enumerate((("body", "over"), ("below", "under")), 1):
            if isinstance(node.get(key), dict):
                self.join(out, self.node(node[key]), relation, order)
        return out

    def marked(self, node: dict, role: str, reason: str, **attrs) -> str:
        """A group of a mark that shows nothing and the body behind it."""
        out = self.add("group", role=role, katex_type=node["type"], **attrs)
        self.join(out, self.add("artifact", reason=reason, katex_type=node["type"]), "child", 0)
        body = node.get("body")
        if isinstance(body, (dict, list)):
            self.join(out, self.node(body) if isinstance(body, dict) else self.sequence(body, f"{reason}_body"), "child", 1)
        elif role == "enclosure":
            self.warn("enclosure_missing_body")
        return out

    def on_enclose(self, node: dict) -> str:
        return self.marked(node, "enclosure", "enclosure", label=str(node.get("label", "") or ""))

    def on_layout(self, node: dict) -> str:
        return self.marked(node, f"layout:{node['type']}", node["type"])

    def on_middle(self, node: dict) -> str:
        return self.symbol(_said(node), katex_type="middle", delimiter_role="middle")

    def on_delimsizing(self, node: dict) -> str:
        return self.symbol(_said(node), katex_type="delimsizing", delimiter_role="sized", atom_class=str(node.get("mclass", "") or ""))

    def on_spacing(self, node: dict) -> str:
        return self.add("artifact", reason=node["type"], katex_type=node["type"])

    on_kern = on_spacing

    def on_other(self, node: dict) -> str:
        kind = str(node.get("type", "") or "")
        self.warn(f"unsupported_katex_type:{kind or 'missing'}")
        if isinstance(node.get("body"), list):
            return self.sequence(node["body"], f"unsupported:{kind}")
        if text := _said(node):
            return self.symbol(text, katex_type=kind)
        return self.add("artifact", reason="unsupported_katex_node", katex_type=kind)


def _hangs_left(node: object) -> bool:
    """Whether scripts stand on an empty group, so that they belong to what follows."""
    if not isinstance(node, dict) or node.get("type") != "supsub" or not isinstance(node.get("base"), dict):
        return False
    empty = node["base"].get("type") == "ordgroup" and not (isinstance(node["base"].get("body"), list) and node["base"]["body"])
    return empty and any(isinstance(node.get(k), dict) for k in ("sub", "sup"))


def build(parsed: object, mathml: str = "") -> dict | None:
    """root, nodes (id, kind, value, latex, attrs), edges (source, target, relation, order) and warnings; None without a parse tree."""
    if not parsed:
        return None
    tree = _Tree(presentation_text(mathml))
    root = tree.sequence(parsed if isinstance(parsed, list) else [parsed], "root")
    return {"root": root, "nodes": tree.nodes, "edges": tree.edges, "warnings": sorted(tree.warnings)}


def counts(parsed: object, mathml: str = "") -> tuple[Counter, Counter]:
    """Types of the parse tree and tags of the MathML, counted."""
    types: Counter = Counter()

    def walk(value: object) -> None:
        if isinstance(value, list):
            for x in value:
                walk(x)
        elif isinstance(value, dict):
            types.update([str(value["type"])] if value.get("type") else [])
            for key in COUNTED:
                walk(value.get(key))

    walk(parsed)
    root = _xml(mathml)
    return types, Counter(x.tag.rsplit("}", 1)[-1] for x in root.iter()) if root is not None else Counter()


#: Tags that a node's kind gives by itself.
KIND_TAGS = {"script": "script", "fraction": "fraction", "radical": "radical", "accent": "accent_annotation", "under_over": "under_over", "fence": "fence", "equation_number": "equation_tag", "symbol": "symbol", "text_run": "text_run", "group": "group", "matrix": "matrix_grid"}


def tree_tags(tree: dict | None) -> list[str]:
    """Sorted tags of what a tree exercises."""
    if not tree:
        return []
    tags, meant = set(), 0
    for _, kind, value, _, a in tree["nodes"]:
        role, reason = str(a.get("role", "")), str(a.get("reason", ""))
        tags |= {KIND_TAGS[kind]} if kind in KIND_TAGS else set()
        found = {
            "operator": (kind == "symbol" and a.get("katex_type") == "op") or (kind == "text_run" and (a.get("operator") or a.get("katex_type") == "operatorname")),
            "font_identity": (kind == "symbol" and (a.get("identity_aliases") or a.get("family"))) or (kind == "group" and (role.startswith("font:") or a.get("font"))),
            "mathvariant": kind == "group" and (role.startswith("font:") or a.get("font")),
            "style_variant": kind == "group" and (role.startswith(("styling:", "mclass:", "layout:")) or role == "color" or a.get("atom_class")),
            "spacing_artifact": (kind == "group" and role.startswith("layout:")) or (kind == "artifact" and reason in ("spacing", "kern", *LAYOUT)),
            "enclosure": (kind == "group" and role == "enclosure") or (kind == "artifact" and reason == "enclosure"),
            "matrix_grid": kind == "group" and role in ("matrix_row", "matrix_cell"),
            "aligned_display": kind == "matrix" and a.get("display_container") == "aligned_display",
        }
        tags |= {k for k, there in found.items() if there}
        meant += 1 if kind == "symbol" else max(1, len(value)) if kind == "text_run" else 0
    followed = Counter(s for s, _, r, _ in tree["edges"] if r in ("child", "next"))
    return sorted(tags | ({"sequence"} if meant > 1 or max(followed.values(), default=0) > 1 else set()))


TREE = "struct<root:string,nodes:array<struct<id:string,kind:string,value:string,latex:string,attrs:string>>,edges:array<struct<source:string,target:string,relation:string,ord:int>>,warnings:array<string>,tags:array<string>>"


def trees_of(parsed: Column | str, mathml: Column | str) -> Column:
    """``TREE`` of columns of parse trees (JSON) and MathML; null where there is nothing to read. Attributes are JSON with sorted keys."""

    @F.pandas_udf(TREE)
    def run(trees: pd.Series, shown: pd.Series) -> pd.DataFrame:
        rows = []
        for text, m in zip(trees, shown, strict=True):
            try:
                tree = build(json.loads(text or "null"), m or "")
            except ValueError:
                tree = None
            if tree is None:
                rows.append((None, None, None, ["target_tree_parse_empty_or_failed"], []))
                continue
            nodes = [{"id": i, "kind": k, "value": v, "latex": x, "attrs": json.dumps(a, ensure_ascii=False, sort_keys=True)} for i, k, v, x, a in tree["nodes"]]
            rows.append((tree["root"], nodes, [dict(zip(("source", "target", "relation", "ord"), e, strict=True)) for e in tree["edges"]], tree["warnings"], tree_tags(tree)))
        return pd.DataFrame(rows, columns=["root", "nodes", "edges", "warnings", "tags"])

    return run(parsed, mathml)
