"""Display formulas of a page: lines gather to regions, and a region's glyphs are written as LaTeX.

Both depend on order and work on a page at a time, a bounded group. Glyphs are rows (page keys, line, idx, text, font, size, x0, y0,
x1, y1), drawn marks are rows (page keys, x0, y0, x1, y1).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from foliogrid.operators.pages import mapped_pages

#: Font families of mathematics, ranges of its characters, fonts whose letters make words, and footnote marks.
MATH_FAMILIES = ("cmmi", "cmsy", "cmex", "msam", "msbm", "stix", "xits", "latinmodernmath", "cambria math", "symbol")
MATH_RANGES = ((0x2200, 0x22FF), (0x27C0, 0x27EF), (0x2980, 0x29FF), (0x2A00, 0x2AFF), (0x1D400, 0x1D7FF))
WORD_FAMILIES = ("cmr", "roman", "times", "nimbus")
FOOTNOTE_MARKS = frozenset("*∗†‡§")
#: What each sign of a formula adds to a region's confidence.
CONFIDENCE = {"math_font": 0.24, "math_symbol": 0.16, "script_size": 0.12, "near_vector": 0.18, "math_density": 0.16, "centered_line": 0.08, "short_line": 0.05}
LABEL_BONUS, LINES_BONUS = 0.03, 0.06
#: Characters as LaTeX.
SIGNS = {"−": "-", "·": r"\cdot", "×": r"\times", "∈": r"\in", "∼": r"\sim", "≅": r"\cong", "≤": r"\leq", "≥": r"\geq", "√": r"\sqrt{}", "_": r"\_", "^": r"\^"}
OPERATORS = frozenset("=+-−*/·×^_()[]{}|<>√∈∑∫")


@dataclass(frozen=True)
class Settings:
    """Shares of page, body and line sizes that tell display formulas from prose."""

    margin: float = 4.0
    density: float = 0.12
    strong_density: float = 0.32
    centred: float = 0.13
    body_share: float = 0.72
    page_share: float = 0.86
    indent: float = 0.06
    line_gap: float = 0.95
    side_gap: float = 0.34
    least: float = 0.50
    same_region: float = 0.82


class Box(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def width(self) -> float:
        return max(self.x1 - self.x0, 0.0)

    @property
    def height(self) -> float:
        return max(self.y1 - self.y0, 0.0)

    @property
    def mid_x(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def mid_y(self) -> float:
        return (self.y0 + self.y1) / 2

    def grown(self, by: float) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def touches(self, other: Box) -> bool:
        return self.x0 <= other.x1 and other.x0 <= self.x1 and self.y0 <= other.y1 and other.y0 <= self.y1

    def shared(self, other: Box) -> tuple[float, float]:
        """Length in common on either axis; below 0 it is the gap."""
        return min(self.x1, other.x1) - max(self.x0, other.x0), min(self.y1, other.y1) - max(self.y0, other.y0)

    def apart(self, other: Box) -> tuple[float, float]:
        x, y = self.shared(other)
        return max(0.0, -x), max(0.0, -y)


def around(boxes: Iterable[Box]) -> Box:
    real = [b for b in boxes if b != (0, 0, 0, 0)]
    return Box(min(b.x0 for b in real), min(b.y0 for b in real), max(b.x1 for b in real), max(b.y1 for b in real)) if real else Box(0, 0, 0, 0)


@lru_cache(1024)
def _math_font(font: str) -> bool:
    return any(f in font.split("+")[-1].lower() for f in MATH_FAMILIES)


@lru_cache(1024)
def _word_font(font: str) -> bool:
    return any(f in font.lower() for f in WORD_FAMILIES)


@lru_cache(4096)
def _math_sign(character: str) -> bool:
    return bool(character) and any(a <= ord(character) <= b for a, b in MATH_RANGES)


class Glyph(NamedTuple):
    text: str
    font: str
    size: float
    box: Box

    @property
    def unknown(self) -> bool:
        return self.text in ("", "\ufffd") or self.text.startswith("cid:")

    @property
    def math_font(self) -> bool:
        return _math_font(self.font)

    @property
    def math_sign(self) -> bool:
        return _math_sign(self.text[:1])

    @property
    def mathematical(self) -> bool:
        return self.math_font or self.math_sign or self.unknown

    @property
    def word_letter(self) -> bool:
        return len(self.text) == 1 and self.text.isalpha() and not self.math_font and _word_font(self.font)


def upper_median(values: Iterable[float], default: float) -> float:
    real = sorted(v for v in values if v > 0)
    return real[len(real) // 2] if real else default


def has_scripts(glyphs: Sequence[Glyph]) -> bool:
    """Whether clearly smaller glyphs stand clearly above or below the mean middle of the others."""
    sized = [g for g in glyphs if not g.text.isspace()]
    top = max((g.size for g in sized if g.size > 0), default=0.0)
    edge = top * 0.86
    if sum(g.size > 0 for g in sized) < 2 or min(g.size for g in sized if g.size > 0) >= edge:
        return False
    base, small = [g.box.mid_y for g in sized if g.size >= edge], [g.box.mid_y for g in sized if g.size < edge]
    return bool(base and small) and any(abs(y - sum(base) / len(base)) >= max(1.2, top * 0.12) for y in small)


def signs_of(glyphs: Sequence[Glyph]) -> set[str]:
    found = {"math_font": any(g.math_font for g in glyphs), "math_symbol": any(g.math_sign for g in glyphs), "script_size": has_scripts(glyphs), "unknown_glyph": any(g.unknown for g in glyphs)}
    return {name for name, there in found.items() if there}


def is_label(text: str, x0: float, page_width: float) -> bool:
    """An equation's number in brackets on the right."""
    return 3 <= len(text) <= 8 and text[0] == "(" and text[-1] == ")" and all(c.isdigit() or c in ".-" for c in text[1:-1]) and x0 >= page_width * 0.68


@dataclass
class Line:
    """A line with ink, what is known of it, and the marks near it."""

    number: int
    text: str
    box: Box
    ink: list[Glyph]
    near: list[int]
    signs: set[str] = field(default_factory=set)
    label: bool = False

    @property
    def density(self) -> float:
        return sum(g.mathematical for g in self.ink) / len(self.ink) if self.ink else 0.0

    @property
    def footnote(self) -> bool:
        text = "".join(g.text for g in self.ink)
        if 1 <= len(text) <= 3 and FOOTNOTE_MARKS.issuperset(text):
            return True
        marks = [g.text for g in self.ink if g.mathematical]
        words = [w for w in re.split(r"[.,\s]+", text) if len(w) >= 2 and any(c.isalpha() for c in w)]
        return bool(marks) and all(m in FOOTNOTE_MARKS for m in marks) and bool(words)


class Region(NamedTuple):
    box: Box
    text: str
    lines: int
    vectors: int
    signs: tuple[str, ...]
    confidence: float


class Page:
    """Lines and marks of a page, with the span that its body text takes."""

    def __init__(self, lines: Sequence[Sequence[Glyph]], vectors: Sequence[Box], size: tuple[float, float], settings: Settings = Settings(), boxes: Sequence[Box] | None = None):
        self.size, self.vectors, self.set = size, list(vectors), settings
        self.glyphs = [list(line) for line in lines]
        self.boxes = list(boxes) if boxes is not None else [around(g.box for g in line) for line in lines]
        self.lines: list[Line] = []
        for glyphs, box in zip(self.glyphs, self.boxes, strict=True):
            text = "".join(g.text for g in glyphs)
            if not text.strip():
                continue
            ink = [g for g in glyphs if g.text and not g.text.isspace()]
            line = Line(len(self.lines), text, box, ink, [i for i, v in enumerate(self.vectors) if box.grown(settings.margin).touches(v)])
            line.signs = signs_of(ink) | ({"math_density"} if line.density >= settings.density else set()) | ({"near_vector"} if line.near else set())
            line.label = is_label("".join(g.text for g in ink), box.x0, size[0])
            if line.label:
                line.signs.add("equation_label")
            self.lines.append(line)
        wide = [n.box for n in self.lines if len(n.ink) >= 20 and not n.label and n.box.width >= size[0] * 0.35]
        half = len(wide) // 2
        self.left, self.right = (sorted(b.x0 for b in wide)[half], sorted(b.x1 for b in wide)[half]) if wide else (0.0, 0.0)
        if self.right <= self.left:
            self.left, self.right = size[0] * 0.08, size[0] * 0.92
        self.body = max(self.right - self.left, 1.0)
        for line in self.lines:
            line.signs |= ({"centered_line"} if self.centred(line.box) else set()) | ({"short_line"} if self.short(line.box) else set())

    def centred(self, box: Box) -> bool:
        return abs(box.mid_x - (self.left + self.right) / 2) <= self.body * self.set.centred

    def short(self, box: Box) -> bool:
        indent = self.body * self.set.indent
        return box.width <= self.body * self.set.body_share or (box.x0 >= self.left + indent and box.x1 <= self.right - indent)

    def displayed(self, box: Box) -> bool:
        """Centred, or short and away from both edges of the body."""
        indent = self.body * self.set.indent
        return self.centred(box) or (box.width <= self.body * self.set.body_share and box.x0 - self.left >= indent and self.right - box.x1 >= indent)

    def seed(self, line: Line) -> bool:
        s, box = self.set, line.box
        if not line.ink or line.label or line.footnote or box.width > max(self.size[0], 1.0) * s.page_share or not self.displayed(box):
            return False
        if not line.signs & {"math_font", "math_symbol", "script_size", "unknown_glyph", "near_vector"}:
            return False
        if line.density >= s.strong_density:
            return (box.width >= self.body * 0.08 or self.centred(box)) and (box.width <= self.body * s.body_share or bool(line.near))
        if line.density < s.density:
            return False
        if line.near:
            return box.width >= self.body * 0.08
        return {"centered_line", "short_line"} <= line.signs and self.body * 0.10 <= box.width <= self.body * s.body_share

    def fits(self, line: Line, group: list[Line]) -> bool:
        """Whether a seed goes on with a group: close enough, and touching, near one mark, or one above the other."""
        box, s = around(n.box for n in group), self.set
        across, down = line.box.apart(box)
        tall = upper_median([n.box.height for n in [*group, line]], 10.0)
        if down > tall * s.line_gap or across > self.size[0] * s.side_gap:
            return False
        if line.box.grown(s.margin).touches(box.grown(s.margin)) or any(set(line.near) & set(n.near) for n in group):
            return True
        return abs(line.box.mid_x - box.mid_x) <= self.body * s.centred or line.box.shared(box)[0] >= -self.size[0] * 0.04

    def part(self, line: Line, box: Box) -> bool:
        """Whether another line with mathematics belongs to a group's box."""
        tall = max(line.box.height, 1.0)
        across, down = line.box.apart(box)
        if line.box.shared(box)[1] < -tall * self.set.line_gap and down > tall:
            return False
        return across <= self.body * 0.12 or line.box.grown(self.set.margin).touches(box.grown(self.set.margin))

    def numbers(self, label: Line, box: Box) -> bool:
        if label.box.x0 < self.right - self.body * 0.18:
            return False
        tall = max(label.box.height, 1.0)
        return label.box.shared(box)[1] >= -max(tall, box.height, 1.0) * 0.35 or label.box.apart(box)[1] <= tall * self.set.line_gap

    def regions(self) -> list[Region]:
        groups: list[list[Line]] = []
        for line in sorted((n for n in self.lines if self.seed(n)), key=lambda n: (n.box.y0, n.box.x0)):
            near = [(sum(line.box.apart(around(n.box for n in g))), i) for i, g in enumerate(groups) if self.fits(line, g)]
            groups[min(near)[1]].append(line) if near else groups.append([line])
        taken = {n.number for g in groups for n in g}
        signed = {"near_vector", "script_size", "math_symbol", "unknown_glyph"}
        parts = [n for n in self.lines if n.number not in taken and not n.label and not n.footnote and (n.density >= 0.80 or (n.density >= 0.20 and n.signs & signed))]
        for group in groups:
            # a group's box grows by what joins it, so it asks again until nobody joins
            left = parts
            while True:
                box = around(n.box for n in group)
                joined = [n for n in left if self.part(n, box)]
                if not joined:
                    break
                group += joined
                left = [n for n in left if n not in joined]
            box = around(n.box for n in group)
            group += [n for n in self.lines if n.label and self.numbers(n, box)]
        found = sorted((r for r in map(self.summary, groups) if r.confidence >= self.set.least), key=lambda r: (-r.confidence, r.box.y0, r.box.x0))
        kept: list[Region] = []
        for r in found:
            if all(_of_smaller(r.box, k.box) <= self.set.same_region for k in kept):
                kept.append(r)
        return sorted(kept, key=lambda r: (r.box.y0, r.box.x0))

    def summary(self, group: list[Line]) -> Region:
        ordered = sorted(group, key=lambda n: (n.box.y0, n.box.x0, n.number))
        box = around(n.box for n in ordered)
        vectors = sum(box.grown(self.set.margin).touches(v) for v in self.vectors)
        signs = set().union(*(n.signs for n in ordered))
        held = signs | ({"near_vector"} if vectors else set())
        score = sum(v for k, v in CONFIDENCE.items() if k in held) + (LABEL_BONUS if any(n.label for n in ordered) else 0) + (LINES_BONUS if len(ordered) > 1 else 0)
        return Region(box, " ".join(n.text.strip() for n in ordered), len(ordered), vectors, tuple(sorted(signs)), round(min(score, 1.0), 3))


def _of_smaller(a: Box, b: Box) -> float:
    x, y = a.shared(b)
    return max(x, 0) * max(y, 0) / min(max(a.width * a.height, 1.0), max(b.width * b.height, 1.0))


def like_formula(glyphs: Sequence[Glyph]) -> bool:
    """Whether glyphs read as an expression rather than as text or a table."""
    text = "".join(g.text for g in glyphs if not g.text.isspace())
    operators, digits, letters = sum(c in OPERATORS for c in text), sum(c.isdigit() for c in text), sum(c.isalpha() for c in text)
    marked, roman = sum(g.mathematical for g in glyphs), sum(g.word_letter for g in glyphs)
    if not text:
        return False
    if (operators >= 2 and marked >= 1) or (operators >= 3 and digits + marked >= 2):
        return True
    if (letters >= 10 and roman / letters > 0.65 and operators < 3) or (digits >= 12 and operators >= 4 and marked <= 2):
        return False
    return marked >= 2 and operators >= 1


def rows_of(glyphs: Sequence[Glyph]) -> list[list[Glyph]]:
    """Glyphs in rows from top to bottom, each from left to right: a glyph joins the first row whose mean middle is near its own."""
    rows: list[list[Glyph]] = []
    for g in sorted(glyphs, key=lambda g: (g.box.mid_y, g.box.x0)):
        for row in rows:
            tall = upper_median([x.box.height for x in [*row, g]], 10.0)
            if abs(g.box.mid_y - sum(x.box.mid_y for x in row) / len(row)) <= tall * 0.42:
                row.append(g)
                break
        else:
            rows.append([g])
    return [sorted(row, key=lambda g: g.box.x0) for row in rows]


def script_of(base: Glyph, g: Glyph) -> str:
    """``^`` or ``_`` if a glyph is a script of another, else nothing."""
    tall = max(base.box.height, 1.0)
    gap, rise = g.box.x0 - base.box.x1, g.box.mid_y - base.box.mid_y
    if not 0 < g.box.height < tall * 0.90 or not -tall * 0.15 <= gap <= tall * 0.95 or abs(rise) <= tall * 0.10:
        return ""
    return "^" if rise < 0 else "_"


def _small_part(glyphs: Sequence[Glyph]) -> bool:
    """Whether glyphs may stand over or under a fraction's bar."""
    if not glyphs or len(glyphs) > 18 or len(rows_of(glyphs)) > 2 or not any(g.mathematical for g in glyphs):
        return False
    return around(g.box for g in glyphs).height <= upper_median([g.box.height for g in glyphs], 10.0) * 2.9


def _over(g: Glyph, bar: Box, margin: float) -> bool:
    return g.box.x1 >= bar.x0 - margin and g.box.x0 <= bar.x1 + margin


class Writer:
    """Glyphs with the marks among them as LaTeX."""

    def __init__(self, vectors: Sequence[Box]):
        self.vectors = list(vectors)

    def bar(self, glyphs: Sequence[Glyph]) -> Box | None:
        """The widest drawn line with a small part above it and one below."""
        best = None
        for v in self.vectors:
            if v.width < 6 or v.height > max(1.5, v.width * 0.18) or (best is not None and v.width <= best.width):
                continue
            near = [g for g in glyphs if _over(g, v, 1.0)]
            if _small_part([g for g in near if g.box.mid_y < v.mid_y - 0.8]) and _small_part([g for g in near if g.box.mid_y > v.mid_y + 0.8]):
                best = v
        return best

    def fraction(self, glyphs: Sequence[Glyph], bar: Box) -> str:
        above = [g for g in glyphs if _over(g, bar, 1.0) and g.box.mid_y < bar.mid_y - 0.8]
        below = [g for g in glyphs if _over(g, bar, 2.0) and (g.box.mid_y > bar.mid_y + 0.4 or g.text == "√")]
        rest = [g for g in glyphs if g not in above and g not in below]
        before, after = [g for g in rest if g.box.mid_x < bar.x0 - 0.6], [g for g in rest if g.box.mid_x > bar.x1 + 0.6]
        parts = [self.block(before), rf"\frac{{{self.block(above)}}}{{{self.block(below)}}}", self.block(after)]
        return " ".join(p for p in parts if p.strip())

    def block(self, glyphs: Sequence[Glyph]) -> str:
        ink = [g for g in glyphs if g.text and not g.text.isspace()]
        if len(ink) > 1 and ink[0].text == "√":
            return rf"\sqrt{{{self.block(ink[1:])}}}"
        return r" \\ ".join(filter(None, map(self.row, rows_of(ink))))

    def row(self, glyphs: Sequence[Glyph]) -> str:
        """A row token by token: scripts go to the token before them, roots take what is under their bar, letters of text fonts make words."""
        todo = sorted(glyphs, key=lambda g: (g.box.x0, g.box.y0))
        out: list[str] = []
        last: Glyph | None = None
        i = 0
        while i < len(todo):
            g = todo[i]
            kind = script_of(last, g) if last else ""
            end = i + 1
            if kind:
                edge = last.box.x1
                end = i
                while end < len(todo) and script_of(last, todo[end]) == kind and todo[end].box.x0 - edge <= max(last.box.height, 1.0) * 1.2:
                    edge, end = todo[end].box.x1, end + 1
                if end > i:
                    out[-1] += f"{kind}{{{self.row(todo[i:end])}}}"
                    i = end
                    continue
                end = i + 1
            if g.text == "√":
                body, end = self.root(todo, i)
                out.append(rf"\sqrt{{{self.row(body)}}}" if body else SIGNS["√"])
                last = body[-1] if body else g
                i = end if body else i + 1
                continue
            while g.word_letter and end < len(todo) and todo[end].word_letter and todo[end].box.x0 - todo[end - 1].box.x1 <= max(g.box.height * 0.45, 3.0):
                end += 1
            word = todo[i:end]
            out.append(rf"\mathrm{{{''.join(x.text for x in word)}}}" if len(word) > 1 else r"\unknown" if g.unknown else SIGNS.get(g.text, g.text))
            last, i = word[-1], end
        return tidy(out)

    def root(self, todo: Sequence[Glyph], i: int) -> tuple[list[Glyph], int]:
        """What a root holds, and where the row goes on: what is under its bar, or the next glyph."""
        sign = todo[i].box
        bars = [v for v in self.vectors if v.width >= max(sign.width, 4.0) and abs(v.y0 - sign.y0) <= max(sign.height, 1.0) and sign.x0 - 1.0 <= v.x0 <= sign.x1 + 3.0]
        if not bars:
            return list(todo[i + 1 : i + 2]), i + 2
        bar = max(bars, key=lambda v: v.width)
        end = i + 1
        while end < len(todo) and todo[end].box.x0 <= bar.x1 + 1.0:
            end += 1
        return [g for g in todo[i + 1 : end] if _over(g, bar, 1.0) and g.box.y0 >= bar.y0 - 1.5], end


#: How blanks round punctuation, brackets and scripts go, in order.
_TIDY = [(re.compile(p), by) for p, by in ((r"\s+([,.;:)\\}\\]])", r"\1"), (r"([({\\[])\s+", r"\1"), (r"\s+([_^])", r"\1"), (r"([_^])\s+", r"\1"), (r"\\mathrm\{([A-Za-z]+)\}\s*\(", r"\\mathrm{\1}("))]


def tidy(tokens: Iterable[str]) -> str:
    text = " ".join(t for t in tokens if t)
    for pattern, by in _TIDY:
        text = pattern.sub(by, text)
    return text.strip()


def region_latex(page: Page, region: Region) -> tuple[str, float, tuple[str, ...], tuple[str, ...]]:
    """(latex, confidence, evidence, warnings) of a region, from the glyphs and marks that touch it."""
    box = region.box.grown(1.0)
    ink: list[Glyph] = []
    for glyphs, own in zip(page.glyphs, page.boxes, strict=True):
        part = [g for g in glyphs if g.text and not g.text.isspace() and g.box.touches(box)] if own.touches(box) else []
        if part and not is_label("".join(g.text for g in part), around(g.box for g in part).x0, page.size[0]):
            ink += part
    if not ink:
        return "", 0.0, tuple(sorted(region.signs)), ("empty_region",)
    writer = Writer([v for v in page.vectors if v.touches(box)])
    formula = like_formula(ink)
    bar = writer.bar(ink) if formula else None
    text = writer.fraction(ink, bar) if bar else writer.block(ink)
    text = re.sub(r"\s+", " ", re.sub(r" ?\\\\ ?", r" \\\\ ", re.sub(r"[ \t]+", " ", text.strip()))).strip()
    evidence = set(region.signs) | ({"fraction_vector"} if bar else set()) | ({"radical_glyph"} if any(g.text == "√" for g in ink) else set()) | ({"script_layout"} if has_scripts(ink) else set())
    warnings = [*(["table_or_text_like_region"] if not formula else []), *(["unknown_glyph"] if any(g.unknown for g in ink) else [])]
    return text, round(min(1.0, region.confidence + 0.06) if bar else region.confidence, 3), tuple(sorted(evidence)), tuple(warnings)


_COLUMNS = "region int, x0 double, y0 double, x1 double, y1 double, text string, lines int, vectors int, evidence string, confidence double, latex string, latex_confidence double, latex_evidence string, warnings string"


def _number(x: float | None) -> float:
    return math.nan if x is None else float(x)


def display_regions(glyphs: DataFrame, vectors: DataFrame, keys: list[str], size: tuple[float, float], settings: Settings = Settings()) -> DataFrame:
    """A row for each display formula of each page: where it is, its text, evidence and confidence, and its LaTeX with its own."""

    def run(own: list[tuple], marks: list[tuple]) -> Iterator[tuple]:
        if not own:
            return
        lines: dict = {}
        for line, _, text, font, points, *corners in sorted((r for r in own if r[0] is not None), key=lambda r: (r[0], r[1] is None, r[1])):
            lines.setdefault(line, []).append(Glyph(text or "", font or "", _number(points), Box(*map(_number, corners))))
        page = Page(list(lines.values()), [Box(*b) for b in sorted((tuple(map(_number, b)) for b in marks), key=lambda b: [(x != x, x) for x in b])], size, settings)
        for i, r in enumerate(page.regions()):
            latex, sure, evidence, warnings = region_latex(page, r)
            yield i, *r.box, r.text, r.lines, r.vectors, ",".join(r.signs), r.confidence, latex, sure, ",".join(evidence), ",".join(warnings)

    box = ["x0", "y0", "x1", "y1"]
    return mapped_pages([glyphs.select(*keys, "line", "idx", "text", "font", "size", *box), vectors.select(*keys, *box)], keys, run, _COLUMNS)
