"""Supervision of a graph parser: a target tree's leaves aligned with a page's glyphs, labels from the tree, and training samples.

A formula is a bounded group. Glyphs and marks are (id, text, latex, x0, y0, x1, y1); trees are those of ``targets``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from foliogrid.operators import targets
from foliogrid.operators.decode import RELATIONS, UNTAUGHT

#: How sure a match must be to count, and to count as hard; what a skipped glyph costs, and at most.
LEAST, HARD, SKIP, SKIPS, SURE = 0.45, 0.90, 0.02, 0.20, 0.98
LOW_COVERAGE = 0.70
#: A tree's relations as labels, and those whose source is the node's base.
LABELS = {r: r.upper() for r in "base sub sup pre_sub pre_sup under over numerator denominator radical_body radical_index accent_base fence_body fence_open fence_close matrix_row matrix_cell cell_content child next".split()}
FROM_BASE = {"script": ("sub", "sup", "pre_sub", "pre_sup"), "under_over": ("under", "over")}
SEQUENCES = ("child", "next", "cell_content")
#: Evidence of structures by kind: the role, its fields by the children that fill them, and which of these it needs.
EVIDENCE = {
    "fraction": ("FRACTION_SEPARATOR", {"above": "numerator", "below": "denominator"}, lambda f: f["above"] and f["below"]),
    "radical": ("RADICAL_MARK", {"body": "radical_body", "index": "radical_index", "mark": ""}, lambda f: f["body"]),
    "under_over": ("UNDER_OVER", {"base": "base", "under": "under", "over": "over"}, lambda f: f["base"] and (f["under"] or f["over"])),
    "accent": ("ACCENT_ANNOTATION", {"base": "accent_base"}, lambda f: f["base"]),
    "fence": ("FENCE", {"body": "fence_body", "open": "fence_open", "close": "fence_close"}, lambda f: f["body"]),
    "left_attachment": ("LEFT_ATTACHMENT", {"base": "base", "pre_sub": "pre_sub", "pre_sup": "pre_sup"}, lambda f: f["base"] and (f["pre_sub"] or f["pre_sup"])),
}
#: Boundaries of groups, likewise; their members stay in the tree's order.
BOUNDARIES = {
    "script": ("SCRIPT_GROUP_BOUNDARY", {k: k for k in ("base", "sub", "sup", "pre_sub", "pre_sup")}, lambda f: any(f.values())),
    "fraction": ("FRACTION_GROUP_BOUNDARY", {"numerator": "numerator", "denominator": "denominator"}, lambda f: any(f.values())),
    "radical": ("RADICAL_GROUP_BOUNDARY", {"body": "radical_body", "index": "radical_index", "mark": ""}, lambda f: f["body"] or f["index"]),
    "fence": ("FENCE_GROUP_BOUNDARY", {"body": "fence_body", "open": "fence_open", "close": "fence_close"}, lambda f: f["body"]),
}
#: Least scores of marks for roles, and the mark's relation and its children's.
LEAST_MARK = {"FRACTION_SEPARATOR": 0.45, "RADICAL_MARK": 0.45, "ACCENT_ANNOTATION": 0.45, "ENCLOSURE": 0.35, "FENCE": 0.45, "MATRIX_GRID": 0.45}
MARK_ROLES = {"FRACTION_SEPARATOR": "FRACTION_BAR", "RADICAL_MARK": "RADICAL_MARK", "ENCLOSURE": "ENCLOSURE_RULE", "FENCE": "FENCE_DELIMITER", "MATRIX_GRID": "MATRIX_BORDER"}
OPERATOR_TYPES = ("op", "bin", "rel", "open", "close", "punct")
#: The weight of nodes that nothing labels.
UNKNOWN_WEIGHT = 0.25

Box = tuple[float, float, float, float]


class Item(NamedTuple):
    """A glyph or a mark."""

    id: str
    text: str
    latex: str
    box: Box
    rule: bool = False

    @property
    def place(self) -> tuple[float, float, str]:
        return (self.box[0], self.box[1], self.id)


class Match(NamedTuple):
    glyph: str
    target: str
    confidence: float
    key: int
    kind: str

    @property
    def hard(self) -> bool:
        return self.confidence >= HARD


class Label(NamedTuple):
    """Evidence of a structure: its role, the tree's node, glyphs by field, and how sure it is."""

    role: str
    target: str
    fields: dict[str, list[str]]
    confidence: float
    supervision: str
    detail: str = ""


def leaf_units(tree: dict) -> list[tuple[str, str, int, str, list[str]]]:
    """(node, text, place in it, kind, aliases) of what a tree shows, in order: symbols, the characters of texts and tags, a root's sign."""
    nodes = {n[0]: n for n in tree["nodes"]}
    below = defaultdict(list)
    for s, t, relation, order in tree["edges"]:
        below[s].append((order, relation, t))
    out, todo = [], [tree["root"]]
    while todo:
        name = todo.pop()
        if name not in nodes:
            continue
        _, kind, value, latex, attrs = nodes[name]
        if kind == "symbol":
            out.append((name, value or latex, 0, kind, list(attrs.get("identity_aliases", []))))
        elif kind in ("text_run", "equation_number"):
            out += [(name, c, i, kind, []) for i, c in enumerate(value)]
        elif kind != "artifact":
            if kind == "radical":
                out.append((name, r"\sqrt", 0, kind, []))
            todo += [t for _, _, t in sorted(below[name], reverse=True)]
    return out


def match_score(target: str, text: str, latex: str, aliases: Sequence[str] = ()) -> float:
    """How well a glyph shows a target's text."""
    target, text, latex = target.strip(), (text or "").strip(), (latex or "").strip()
    if not target:
        return 0.0
    if targets.symbol_keys(target, *aliases) & targets.symbol_keys(text, latex) or target in (text, latex):
        return 1.0
    if len(target) > 1 and text and target.startswith(text):
        return 0.72
    if len(text) > 1 and text.startswith(target):
        return 0.68
    return 0.88 if target.lower() in (text.lower(), latex.lower()) else 0.0


def align(tree: dict, glyphs: Sequence[Item]) -> list[Match]:
    """Targets and glyphs matched in order, each glyph once: the best one from where the last match ended, less a little for each skipped."""
    ordered, begin, out = sorted(glyphs, key=lambda g: g.place), 0, []
    for node, text, place, kind, aliases in leaf_units(tree):
        best, at = 0.0, -1
        for i in range(begin, len(ordered)) if text.strip() else ():
            score = match_score(text, ordered[i].text, ordered[i].latex or ordered[i].text, aliases) - min(SKIPS, (i - begin) * SKIP)
            if score > best:
                best, at = score, i
            if score >= SURE:
                break
        if at >= 0 and best >= LEAST:
            out.append(Match(ordered[at].id, node, round(min(1.0, best), 6), place, kind))
            begin = at + 1
    return out


def _unique(ids: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(ids))


class Supervision:
    """A tree with the glyphs matched to it, and the labels that follow."""

    def __init__(self, tree: dict, items: Sequence[Item]):
        self.tree, self.glyphs, self.marks = tree, [x for x in items if not x.rule], sorted((x for x in items if x.rule), key=lambda x: x.place)
        self.boxes = {x.id: x.box for x in items}
        self.matches = align(tree, self.glyphs)
        self.nodes = {n[0]: n for n in tree["nodes"]}
        self.below: dict[str, list[tuple[int, str, str]]] = defaultdict(list)
        for s, t, relation, order in tree["edges"]:
            self.below[s].append((order, relation, t))
        own = defaultdict(list)
        for m in self.matches:
            own[m.target].append(m)
        self.own = own
        self.under: dict[str, list[Match]] = {}
        for name in reversed([n[0] for n in tree["nodes"]]):
            self._collect(name, frozenset())

    def _collect(self, name: str, path: frozenset) -> list[Match]:
        if name not in self.under:
            if name in path:
                return []
            found = list(self.own[name])
            for _, _, t in sorted(self.below[name]):
                if t in self.nodes:
                    found += self._collect(t, path | {name})
            self.under[name] = found
        return self.under[name]

    def child_leaves(self, name: str, relation: str) -> list[Match]:
        if not relation:  # what the node itself shows
            return [m for m in self.under[name] if m.target == name]
        return [m for _, r, t in self.below[name] if r == relation for m in self.under.get(t, [])]

    def chief(self, name: str) -> Match | None:
        return min(self.under.get(name, []), key=lambda m: (-m.confidence, m.glyph), default=None)

    def relations(self) -> list[tuple[str, str, str, float, str]]:
        """(source, target, relation, confidence, supervision) by the tree's edges and sequences, the surest of each."""
        found = []
        for s, t, relation, _ in self.tree["edges"]:
            if relation not in LABELS:
                continue
            base = next((x for _, r, x in self.below[s] if r == "base"), None) if relation in FROM_BASE.get(self.nodes[s][1], ()) else None
            found.append((self.chief(base or s), self.chief(t), LABELS[relation]))
        for s in sorted(self.below):
            row = [c for _, r, t in sorted(self.below[s]) if r in SEQUENCES and (c := self.chief(t))]
            found += [(a, b, "NEXT") for a, b in zip(row, row[1:], strict=False)]
        best: dict[tuple[str, str, str], tuple] = {}
        for a, b, relation in found:
            if a and b and a.glyph != b.glyph:
                one = (a.glyph, b.glyph, relation, round(min(a.confidence, b.confidence), 6), "hard" if a.hard and b.hard else "soft")
                if one[:3] not in best or one[3] > best[one[:3]][3]:
                    best[one[:3]] = one
        return [best[k] for k in sorted(best)]

    def _label(self, role: str, target: str, fields: dict[str, list[Match]], ordered: bool, detail: str = "") -> Label:
        seen = [m for own in fields.values() for m in own]
        ids = {k: _unique(m.glyph for m in own) if ordered else sorted({m.glyph for m in own}) for k, own in fields.items()}
        return Label(role, target, ids, round(min(m.confidence for m in seen), 6) if seen else 0.0, "missing" if not seen else "hard" if all(m.hard for m in seen) else "soft", detail)

    def structures(self) -> list[Label]:
        """Labels of all structures: boundaries of groups, evidence by kind, and the marks that serve them."""
        out: list[Label] = []

        def by_rule(rules: dict, name: str, kind: str, ordered: bool, detail: str = "") -> None:
            if kind in rules:
                role, parts, holds = rules[kind]
                fields = {k: self.child_leaves(name, r) for k, r in parts.items()}
                if holds(fields):
                    out.append(self._label(role, name, fields, ordered, detail))

        for name, kind, _, _, attrs in self.tree["nodes"]:
            members = [m for m in self.under[name] if m.kind != "artifact"]
            role = str(attrs.get("role", ""))
            if kind == "group" and members and role != "root":
                out.append(self._label("GROUP_BOUNDARY", name, {"member": members}, True, role or "group"))
            by_rule(BOUNDARIES, name, kind, True)
            if kind == "matrix":
                self._grid(name, out, "_GROUP_BOUNDARY", True)
        for name, kind, _, _, attrs in self.tree["nodes"]:
            role, held = str(attrs.get("role", "")), self.under[name]
            if kind == "text_run" and self.own[name]:
                runs = sorted(self.own[name], key=lambda m: (m.key, m.glyph))
                out.append(self._label("OPERATOR_TEXT_RUN" if attrs.get("operator") else "TEXT_RUN", name, {"text": runs}, True))
            elif kind == "script" and attrs.get("placement") == "left_attachment":
                by_rule(EVIDENCE, name, "left_attachment", False)
            elif kind == "matrix":
                self._grid(name, out, "", False)
            elif kind == "group" and role == "operator_body" and held:
                out.append(self._label("OPERATOR_TEXT_RUN", name, {"text": held}, True))
            elif kind == "group" and role == "enclosure" and (body := self.child_leaves(name, "child")):
                out.append(self._label("ENCLOSURE", name, {"body": body}, False))
            elif kind == "equation_number" and held:
                out.append(self._label("EQUATION_TAG", name, {"tag": held}, False))
            else:
                by_rule(EVIDENCE, name, kind, False, str(attrs.get("annotation_position", "")))
        return out + self._marks(out)

    def _grid(self, name: str, out: list[Label], suffix: str, ordered: bool) -> None:
        if self.under[name]:
            out.append(self._label(f"MATRIX{'_GRID' if not suffix else ''}{suffix}", name, {"matrix": self.under[name]}, ordered))
        for i, row in enumerate(t for _, r, t in sorted(self.below[name]) if r == "matrix_row"):
            if self.under.get(row):
                out.append(self._label(f"MATRIX_ROW{suffix}", row, {"row": self.under[row]}, ordered, str(i)))
            for j, cell in enumerate(t for _, r, t in sorted(self.below[row]) if r == "matrix_cell"):
                if self.under.get(cell):
                    out.append(self._label(f"MATRIX_CELL{suffix}", cell, {"cell": self.under[cell]}, ordered, f"{i},{j}"))

    def box_of(self, ids: Iterable[str]) -> Box | None:
        boxes = [self.boxes[x] for x in ids if x in self.boxes]
        return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None

    def _marks(self, labels: Sequence[Label]) -> list[Label]:
        out = [Label("VECTOR_ROLE", "", {"vector": [m.id]}, own[1], "pdf_evidence", own[0]) for m in self.marks if (own := rule_label(m.box))]
        for label in labels:
            role = {"over": "OVERLINE", "under": "UNDERLINE"}.get(label.detail) if label.role == "ACCENT_ANNOTATION" else MARK_ROLES.get(label.role)
            if not role or not self.marks:
                continue
            boxes = [self.box_of(ids) for ids in label.fields.values()]
            scores = [(vector_score(m.box, role, *boxes[: 2 if role == "FRACTION_BAR" else 1]), m) for m in self.marks]
            score, mark = max(scores, key=lambda x: x[0])
            if score >= LEAST_MARK[label.role]:
                out.append(Label("VECTOR_ROLE", label.target, {"vector": [mark.id]}, round(min(1.0, score * (label.confidence or 1.0)), 6), "target_pdf_evidence", f"{role}:{label.role}"))
        best: dict[tuple, Label] = {}
        for x in out:
            key = (x.fields["vector"][0], x.target, x.detail)
            if key not in best or x.confidence > best[key].confidence:
                best[key] = x
        return [best[k] for k in sorted(best)]

    def ignored(self) -> list[tuple[str, str]]:
        """(glyph, reason) of glyphs that match nothing."""
        used = {m.glyph for m in self.matches}
        why = lambda t: "spacing_or_blank" if not t.strip() else "unmatched_punctuation_or_marker" if t in ("|", "·", "​") else "unmatched_pdf_node"
        return [(g.id, why(g.text or "")) for g in sorted(self.glyphs, key=lambda g: g.place) if g.id not in used]

    def warnings(self) -> list[str]:
        units = leaf_units(self.tree)
        hard = sum(m.hard for m in self.matches) / len(units) if units else 0.0
        found = {"alignment_no_leaf_matches": bool(units) and not self.matches, "alignment_low_hard_coverage": hard < LOW_COVERAGE, "alignment_unmatched_target_nodes": len(self.matches) < len(units)}
        return [k for k, there in found.items() if there]

    # samples

    def taught(self) -> dict[tuple[str, str], tuple[str, float]]:
        """The relation of each pair that has one: others beat NEXT, then the surer one counts."""
        best: dict[tuple[str, str], tuple[str, float]] = {}
        for s, t, relation, sure in [*[r[:4] for r in self.relations()], *self._by_structures(self.structures())]:
            if relation not in RELATIONS or relation == "NONE" or relation in UNTAUGHT or s not in self.boxes or t not in self.boxes:
                continue
            rank = lambda r: (r[0] != "NEXT", r[1])
            if (s, t) not in best or rank((relation, sure)) > rank(best[s, t]):
                best[s, t] = (relation, sure)
        return best

    def _by_structures(self, labels: Sequence[Label]) -> list[tuple[str, str, str, float]]:
        out: list[tuple[str, str, str, float]] = []
        rows = sorted((int(x.detail), x.fields["row"][0], x.confidence) for x in labels if x.role == "MATRIX_ROW")
        cells = defaultdict(list)
        for x in labels:
            if x.role == "MATRIX_CELL":
                i, j = map(int, x.detail.split(","))
                cells[i].append((j, x.fields["cell"][0], x.confidence))
        for relation, line in [("MATRIX_ROW", rows), *[("MATRIX_CELL", sorted(c)) for c in cells.values()]]:
            out += [(a[1], b[1], relation, min(a[2], b[2])) for a, b in zip(line, line[1:], strict=False)]
        for x in labels:
            f, sure = x.fields, x.confidence or 1.0
            chain = lambda ids, relation, sure=sure: [(a, b, relation, sure) for a, b in zip(ids, ids[1:], strict=False)]
            from_first = lambda field, to, sure=sure, f=f: [(f[field][0], t, relation, sure) for key, relation in to.items() for t in f.get(key, [])] if f.get(field) else []
            if x.role in ("TEXT_RUN", "OPERATOR_TEXT_RUN"):
                out += chain(f["text"], "TEXT_RUN_NEXT")
            elif x.role in ("GROUP_BOUNDARY", "FRACTION_GROUP_BOUNDARY", "MATRIX_ROW_GROUP_BOUNDARY"):
                out += [r for ids in f.values() for r in chain(ids, "NEXT")]
            elif x.role == "FENCE_GROUP_BOUNDARY":
                out += chain(f["body"], "NEXT")
            elif x.role == "SCRIPT_GROUP_BOUNDARY":
                out += from_first("base", {"sub": "SUB", "sup": "SUP", "pre_sub": "PRE_SUB", "pre_sup": "PRE_SUP"})
            elif x.role in ("RADICAL_GROUP_BOUNDARY", "RADICAL_MARK"):
                out += from_first("mark", {"body": "RADICAL_BODY", "index": "RADICAL_INDEX"})
            elif x.role == "UNDER_OVER":
                out += from_first("base", {"under": "UNDER", "over": "OVER"})
            elif x.role == "LEFT_ATTACHMENT":
                out += from_first("base", {"pre_sub": "PRE_SUB", "pre_sup": "PRE_SUP"})
            elif x.role == "FENCE":
                to = from_first("body", {"open": "FENCE_OPEN", "close": "FENCE_CLOSE"})
                out += to + [(t, s, "FENCE_BODY", sure) for s, t, _, _ in to]
            elif x.role in ("MATRIX_CELL", "MATRIX_CELL_GROUP_BOUNDARY"):
                out += [(f["cell"][0], t, "CELL_CONTENT", sure) for t in f["cell"][1:]]
            elif x.role == "EQUATION_TAG":
                out += [(anchor, t, "EQUATION_TAG", sure) for t in f["tag"] if (anchor := self.tag_anchor(f["tag"]))]
            elif x.role in ("ENCLOSURE", "FRACTION_SEPARATOR", "ACCENT_ANNOTATION"):
                out += self._by_mark(x, sure)
        return out

    def _by_mark(self, x: Label, sure: float) -> list[tuple[str, str, str, float]]:
        """A mark's relations to what it serves, if one serves it well enough."""
        f, position = x.fields, x.detail
        if not self.marks or (x.role == "ACCENT_ANNOTATION" and position not in ("over", "under")):
            return []
        boxes = [self.box_of(ids) for ids in f.values()]
        rule = {"ENCLOSURE": "enclosure", "FRACTION_SEPARATOR": "separator", "ACCENT_ANNOTATION": position}[x.role]
        score, mark = max(((evidence_score(m.box, rule, *boxes), m) for m in self.marks), key=lambda s: (s[0], s[1].id))
        if score < LEAST_MARK[x.role]:
            return []
        sure = round(score * sure, 6)
        if x.role == "ENCLOSURE":
            return [(mark.id, t, "ENCLOSURE_BODY", sure) for t in f["body"]]
        if x.role == "FRACTION_SEPARATOR":
            return [(mark.id, mark.id, "FRACTION_BAR", sure), *[(mark.id, t, "ABOVE", sure) for t in f["above"]], *[(mark.id, t, "BELOW", sure) for t in f["below"]]]
        return [(mark.id, mark.id, "OVERLINE" if position == "over" else "UNDERLINE", sure), *[(mark.id, t, "BELOW" if position == "over" else "ABOVE", sure) for t in f["base"]]]

    def tag_anchor(self, tag: Sequence[str]) -> str | None:
        """The glyph that a tag hangs on: the most level one, then the nearest, to its left if there is any."""
        box = self.box_of(tag)
        body = [g for g in self.glyphs if g.id not in tag and (g.text or g.latex).strip()]
        mid = lambda g, a: (g.box[a] + g.box[a + 2]) / 2
        left = [g for g in body if mid(g, 0) <= box[0]]
        return min(left or body, key=lambda g: (abs(mid(g, 1) - (box[1] + box[3]) / 2), abs(mid(g, 0) - box[0]), g.id)).id if body else None

    def node_samples(self) -> list[tuple[str, str, float]]:
        """(node, label, weight) of all glyphs and marks."""
        best: dict[str, Match] = {}
        for m in self.matches:
            if m.glyph not in best or m.confidence > best[m.glyph].confidence:
                best[m.glyph] = m
        better: dict[str, tuple[str, float]] = {}
        named = {"OPERATOR_TEXT_RUN": ("OPERATOR", "text"), "TEXT_RUN": ("TEXT", "text"), "EQUATION_TAG": ("EQUATION_TAG", "tag")}
        for x in self.structures():
            if x.role in named:
                label, field = named[x.role]
                for g in x.fields[field]:
                    if g not in better or (x.confidence or 1.0) >= better[g][1]:
                        better[g] = (label, x.confidence or 1.0)
        spacing = {g for g, why in self.ignored() if why == "spacing_or_blank"}
        out = []
        for item in sorted([*self.glyphs, *self.marks], key=lambda x: x.place):
            if item.rule:
                label = rule_label(item.box)
                out.append((item.id, *(label if label[0] != "VECTOR_RULE" else ("UNKNOWN", UNKNOWN_WEIGHT))))
            elif item.id in best:
                label, sure = self._kind_label(best[item.id].target), best[item.id].confidence
                if item.id in better:
                    label, sure = better[item.id][0], min(sure or better[item.id][1], better[item.id][1])
                out.append((item.id, label, sure))
            else:
                out.append((item.id, "SPACING", 1.0) if item.id in spacing else (item.id, "UNKNOWN", UNKNOWN_WEIGHT))
        return out

    def _kind_label(self, target: str) -> str:
        _, kind, _, _, attrs = self.nodes[target]
        if kind == "text_run":
            return "OPERATOR" if attrs.get("operator") else "TEXT"
        if kind == "equation_number":
            return "EQUATION_TAG"
        return "OPERATOR" if kind == "symbol" and (attrs.get("katex_type") in OPERATOR_TYPES or attrs.get("family") in OPERATOR_TYPES) else "SYMBOL"


def _wide(b: Box) -> float:
    return max(0.0, b[2] - b[0])


def _tall(b: Box) -> float:
    return max(0.0, b[3] - b[1])


def _shared(a: Box, b: Box, axis: int) -> float:
    return max(0.0, min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis]))


def _mid(b: Box, axis: int) -> float:
    return (b[axis] + b[axis + 2]) / 2


def rule_label(box: Box) -> tuple[str, float]:
    """What a mark is by its shape, and how sure."""
    w, h = _wide(box), _tall(box)
    if w <= 0 and h <= 0:
        return "VECTOR_RULE", 0.25
    for name, long, thick in (("HORIZONTAL_RULE", w, h), ("VERTICAL_RULE", h, w)):
        if long / max(thick, 1e-6) >= 6 and thick <= max(long * 0.08, 2):
            return name, 1.0
    return ("HORIZONTAL_RULE" if w >= h else "VERTICAL_RULE"), 0.75


def _shapes(v: Box) -> tuple[float, float]:
    """How much a mark is a level line, and an upright one."""
    w, h = _wide(v), _tall(v)
    return (min(1.0, w / max(h, 1e-6) / 6) if w > 0 else 0.0), (min(1.0, h / max(w, 1e-6) / 6) if h > 0 else 0.0)


def vector_score(v: Box, role: str, body: Box | None, below: Box | None = None) -> float:
    """How well a mark plays a role for a body: its shape, how much it spans, and how near it is to where it should be."""
    if body is None or (role == "FRACTION_BAR" and below is None):
        return 0.0
    level, upright = _shapes(v)
    y, x = _mid(v, 1), _mid(v, 0)
    if role == "FRACTION_BAR":
        both = (min(body[0], below[0]), 0.0, max(body[2], below[2]), 0.0)
        gap = max(1.0, abs(below[1] - body[3]), _tall(body), _tall(below))
        between = min(body[3], below[1]) - gap <= y <= max(body[3], below[1]) + gap
        near = max(float(between), 1 - abs(y - (body[3] + below[1]) / 2) / gap, 0.0)
        score = 0.45 * level + 0.35 * _shared(v, both, 0) / max(1e-6, _wide(both)) + 0.20 * near if level else 0.0
    elif role in ("RADICAL_MARK", "OVERLINE", "UNDERLINE"):
        edge = body[3] if role == "UNDERLINE" else body[1]
        score = 0.45 * level + 0.35 * _shared(v, body, 0) / max(1e-6, _wide(body)) + 0.20 * max(0.0, 1 - abs(y - edge) / max(1.0, _tall(body))) if level else 0.0
    elif role == "FENCE_DELIMITER":
        off = min(abs(x - body[0]), abs(x - body[2])) / max(1.0, _wide(body))
        score = 0.45 * upright + 0.35 * _shared(v, body, 1) / max(1e-6, _tall(body)) + 0.20 * max(0.0, 1 - off) if upright else 0.0
    else:  # a frame's or a grid's line
        axis = 0 if level >= upright else 1
        size = (_wide(body), _tall(body))
        span = _shared(v, body, axis) / max(1.0 if role == "ENCLOSURE_RULE" else 1e-6, size[axis])
        off = min(abs(v[1 - axis] - body[1 - axis]), abs(v[1 - axis] - body[3 - axis])) / max(1.0, size[1 - axis])
        score = 0.40 * max(level, upright) + 0.35 * span + 0.25 * max(0.0, 1 - off) if max(level, upright) else 0.0
    return round(max(0.0, min(1.0, score)), 6)


def evidence_score(v: Box, rule: str, body: Box | None, below: Box | None = None) -> float:
    """How well a mark supports a relation in training: a separator between two groups, a line over or under one, a frame's side."""
    if body is None or (rule == "separator" and below is None):
        return 0.0
    level, upright = (max(0.0, min(1.0, 1 - t / max(w, 1e-6))) if w > 0 else 0.0 for w, t in ((_wide(v), _tall(v)), (_tall(v), _wide(v))))
    y = _mid(v, 1)
    if rule == "separator":
        top, bottom = _mid(body, 1), _mid(below, 1)
        if top >= bottom:
            return 0.0
        between = 1 - min(1.0, abs(y - (top + bottom) / 2) / max(1e-6, bottom - top))
        between = max(between, 0.85) if top <= y <= bottom else between
        both = (min(body[0], below[0]), 0.0, max(body[2], below[2]), 0.0)
        score = 0.35 * level + 0.35 * between + 0.30 * _shared(v, both, 0) / max(1e-6, _wide(both))
    elif rule in ("over", "under"):
        if (y > _mid(body, 1)) if rule == "over" else (y < _mid(body, 1)):
            return 0.0
        near = 1 - min(1.0, abs(y - _mid(body, 1)) / max(_tall(body) * 2, 1e-6))
        score = 0.40 * level + 0.35 * _shared(v, body, 0) / max(1e-6, _wide(body)) + 0.25 * near
    else:
        axis = 0 if level >= upright else 1
        size = (max(1e-6, _wide(body)), max(1e-6, _tall(body)))
        off = min(abs(v[i] - body[j]) for i in (1 - axis, 3 - axis) for j in (1 - axis, 3 - axis))
        score = 0.45 * max(level, upright) + 0.35 * _shared(v, body, axis) / size[axis] + 0.20 * (1 - min(1.0, off / max(size[1 - axis] * 1.5, 1e-6)))
    return round(max(0.0, min(1.0, score)), 6)


_LABELS = "kind string, role string, source string, target string, confidence double, supervision string"


def labelled(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Labels of formulas: rows (key, tree, items) with ``targets.TREE`` and items (id, text, latex, x0, y0, x1, y1, rule).

    kind is ``match`` (source: glyph, target: the tree's node), ``relation``, ``structure`` (source: its glyphs by field), ``sample`` (a pair's
    relation), ``node`` (a glyph's or mark's label), ``ignored`` or ``warning``.
    """
    import json

    def run(parts):
        for part in parts:
            out = []
            for name, tree, items in zip(part[key], part["tree"], part["items"], strict=True):
                if tree is None or tree["root"] is None:
                    out.append((name, "warning", "missing_target_tree", None, None, None, None))
                    continue
                plain = {"root": tree["root"], "nodes": [(n["id"], n["kind"], n["value"], n["latex"], json.loads(n["attrs"])) for n in tree["nodes"]], "edges": [(e["source"], e["target"], e["relation"], e["ord"]) for e in tree["edges"]]}
                s = Supervision(plain, [Item(x["id"], x["text"] or "", x["latex"] or "", (x["x0"], x["y0"], x["x1"], x["y1"]), bool(x["rule"])) for x in items])
                out += [(name, "match", m.kind, m.glyph, m.target, m.confidence, "hard" if m.hard else "soft") for m in s.matches]
                out += [(name, "relation", r, a, b, c, how) for a, b, r, c, how in s.relations()]
                out += [(name, "structure", x.role + (f":{x.detail}" if x.detail else ""), ";".join(f"{k}={','.join(v)}" for k, v in x.fields.items()), x.target, x.confidence, x.supervision) for x in s.structures()]
                out += [(name, "sample", r, a, b, c, None) for (a, b), (r, c) in sorted(s.taught().items())]
                out += [(name, "node", label, g, None, c, None) for g, label, c in s.node_samples()]
                out += [(name, "ignored", why, g, None, None, None) for g, why in s.ignored()]
                out += [(name, "warning", w, None, None, None, None) for w in s.warnings()]
            yield pd.DataFrame(out, columns=[key, "kind", "role", "source", "target", "confidence", "supervision"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "tree", "items").mapInPandas(run, f"{key} {kind}, {_LABELS}")

