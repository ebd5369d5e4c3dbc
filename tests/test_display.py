"""Display formulas and their LaTeX, on pages set by hand."""

import pytest

from foliogrid.operators import display as D

PAGE = (612.0, 792.0)


def glyph(text, font, size, *box):
    return D.Glyph(text, font, size, D.Box(*map(float, box)))


def prose(text, x, y, font="NimbusRomNo9L-Regu", step=5):
    return [glyph(c, font, 10, x + i * step, y, x + 4 + i * step, y + 10) for i, c in enumerate(text)]


HEAD = [
    glyph("A", "CMR10", 10, 220, 473, 228, 483), glyph("(", "CMR10", 10, 228, 473, 232, 483), glyph("Q", "CMMI10", 10, 232, 473, 240, 483),
    glyph(",", "CMMI10", 10, 240, 473, 244, 483), glyph("K", "CMMI10", 10, 246, 473, 254, 483), glyph(")", "CMR10", 10, 254, 473, 258, 483),
    glyph("=", "CMR10", 10, 262, 473, 270, 483), glyph("s", "CMR10", 10, 274, 473, 280, 483), glyph("(", "CMR10", 10, 280, 473, 284, 483),
    glyph("Q", "CMMI10", 10, 286, 466, 294, 476), glyph("K", "CMMI10", 10, 294, 466, 302, 476), glyph("T", "CMMI7", 7, 303, 465, 308, 472),
]
TAIL = [glyph("d", "CMMI10", 10, 298, 480, 306, 490), glyph("k", "CMMI7", 7, 306, 484, 311, 491), glyph(")", "CMR10", 10, 314, 473, 318, 483), glyph("V", "CMMI10", 10, 318, 473, 326, 483)]


def test_a_split_fraction_and_its_number_are_one_region():
    lines = [prose("before prose", 108, 450), HEAD, [glyph("√", "CMSY10", 10, 290, 473, 298, 483)], TAIL, prose("(1)", 493, 473, step=4), prose("after prose with words", 108, 501)]
    page = D.Page(lines, [D.Box(286, 478, 310, 479), D.Box(298, 480, 310, 481)], PAGE, D.Settings(least=0.45))
    (region,) = page.regions()
    assert (region.lines, region.vectors) == (4, 2) and region.confidence >= 0.45
    assert all(x in region.text for x in ("A(Q,K)=s(QKT", "√", "dk)V", "(1)")) and "before" not in region.text and "after" not in region.text


def test_prose_author_lines_and_wide_sentences_are_none():
    inline = [*prose("We have ", 108, 500, step=8), glyph("x", "CMMI10", 10, 172, 500, 180, 510), glyph("n", "CMMI7", 7, 180, 504, 185, 511), *prose(" and continue on", 186, 500, step=8)]
    assert D.Page([inline], [], PAGE).regions() == []
    author = [*prose("Aidan Gomez", 248, 284, step=8), glyph("∗", "CMSY7", 7, 336, 284, 340, 291), glyph("†", "CMSY7", 7, 341, 284, 345, 291)]
    assert D.Page([author], [], PAGE).regions() == []
    text = "(x1, ..., xn) to another sequence of equal length (z1, ..., zn), with xi, zi ∈Rd"
    wide = [glyph(c, "CMSY10" if c == "∈" else "CMMI10" if c in "xzinRd" else "NimbusRomNo9L-Regu", 10, 108 + 4.8 * i, 540, 112.6 + 4.8 * i, 551) for i, c in enumerate(text)]
    assert D.Page([prose("ordinary body line with enough length", 108, 510), wide], [], PAGE).regions() == []


def test_fractions_roots_and_scripts_are_written():
    lines = [HEAD, [glyph("√", "CMSY10", 10, 286, 473, 294, 483), glyph("d", "CMMI10", 10, 296, 480, 304, 490), glyph("k", "CMMI7", 7, 304, 484, 309, 491), *TAIL[2:]]]
    page = D.Page(lines, [D.Box(286, 478, 310, 479)], PAGE, D.Settings(least=0.45))
    latex, sure, evidence, warnings = D.region_latex(page, page.regions()[0])
    assert r"\frac{" in latex and "Q K^{T}" in latex and r"\sqrt{d_{k}}" in latex
    assert "fraction_vector" in evidence and {"radical_glyph", "script_layout"} <= set(evidence) and warnings == () and 0 < sure <= 1


@pytest.mark.parametrize(
    "text,x0,want",
    [("(1)", 500, True), ("(1.2-3)", 500, True), ("(12345678)", 500, False), ("(a)", 500, False), ("(1)", 300, False), ("1)", 500, False), ("()", 500, False)],
)
def test_labels(text, x0, want):
    assert D.is_label(text, x0, 612) is want


def test_scripts_words_and_unknown_glyphs():
    base, up, down, far = glyph("x", "CMMI10", 10, 0, 0, 8, 10), glyph("2", "CMR7", 7, 8, -3, 12, 4), glyph("i", "CMMI7", 7, 8, 6, 12, 13), glyph("j", "CMMI7", 7, 40, 6, 44, 13)
    assert (D.script_of(base, up), D.script_of(base, down), D.script_of(base, far), D.script_of(up, base)) == ("^", "_", "", "")
    w = D.Writer([])
    assert w.row([base, up]) == "x^{2}" and w.row([base, down]) == "x_{i}"
    assert w.row([glyph(c, "CMR10", 10, 10 * i, 0, 10 * i + 8, 10) for i, c in enumerate("max")]) == r"\mathrm{max}"
    assert w.row([glyph("cid:7", "CMEX10", 10, 0, 0, 8, 10), glyph("≤", "CMSY10", 10, 12, 0, 20, 10)]) == r"\unknown \leq"
    assert w.block([]) == "" and w.block([glyph("√", "CMSY10", 10, 0, 0, 8, 10), base]) == r"\sqrt{x}"
    assert D.rows_of([base, glyph("y", "CMMI10", 10, 0, 30, 8, 40), up])[1][0].text in "xy"


def test_empty_pages(spark):
    g = spark.createDataFrame([], "page int, line int, idx int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double")
    v = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert D.display_regions(g, v, ["page"], PAGE).count() == 0
    rows = [(1, n, i, x.text, x.font, float(x.size), *x.box) for n, line in enumerate([HEAD, TAIL, [], prose("   ", 0, 0)]) for i, x in enumerate(line)]
    g = spark.createDataFrame([*rows, (2, 0, 0, None, None, 1.0, 0.0, 0.0, 1.0, 1.0)], g.schema)
    assert D.display_regions(g, v, ["page"], PAGE).select("page").distinct().collect()[0].page == 1
