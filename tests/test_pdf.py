"""PDF pages written by hand, read as tables."""

import zlib

from foliogrid.sources import pdf as P


def stream(body, more=b"", flate=True):
    packed = zlib.compress(body) if flate else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(packed), b"/Filter /FlateDecode" if flate else b"", more, packed)


CMAP = b"/CIDInit /ProcSet findresource begin 1 beginbfchar <0003> <2211> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <00590059>] endbfrange end"
CONTENT = b"""q 1 0 0 1 10 0 cm BT /F1 12 Tf 100 700 Td (A\\(b\\)) Tj 0 -20 TD [(x) -500 (y)] TJ T* (z) Tj ET Q
BT /F2 10 Tf 1 0 0 1 50 500 Tm <000300100012> Tj <0021> Tj ET
100 650 40 0.5 re f 10 10 m 60 10 l S 5 5 m n q 30 0 0 20 200 300 cm /Im1 Do Q"""


def document(content=CONTENT, two=True):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R%s] /Count 2 /MediaBox [0 0 612 792] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im1 10 0 R >> >> >>" % (b" 9 0 R" if two else b""),
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        4: stream(content),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+CMR10 /FirstChar 65 /Widths [750] /Encoding << /Differences [122 /alpha] >> >>",
        6: b"<< /Type /Font /Subtype /Type0 /BaseFont /CMSY10 /DescendantFonts [7 0 R] /ToUnicode 8 0 R >>",
        7: b"<< /Type /Font /DW 1000 /W [3 [1200] 16 18 600] >>",
        8: stream(CMAP),
        9: b"<< /Type /Page /Parent 2 0 R /Contents [11 0 R 12 0 R] /MediaBox [0 0 100 100] >>",
        10: stream(b"\x00", b"/Subtype /Image /Width 1 /Height 1", flate=False),
        11: stream(b"BT /F1 9 Tf 10 50 Td", flate=False),
        12: stream(b"(B) Tj ET", flate=False),
    }
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer << /Root 1 0 R >>"


def test_glyphs_marks_and_images():
    rows, warnings = P.page_rows(document())
    assert warnings == []
    first = [r for p, _, _, r in rows if p == 0]
    glyphs = [r for r in first if r[0] == "glyph"]
    assert "".join(g[3] for g in glyphs if g[1] == 0) == "A(b)" and [g[3] for g in glyphs if g[1] == 1] == ["x", "y"]
    assert [(g[3], g[6]) for g in glyphs if g[1] == 2] == [("cid:122", "alpha")]
    assert [g[3] for g in glyphs if g[1] == 3] == ["∑", "a", "c", "YY"]
    a = glyphs[0]
    assert a[4] == "ABCDEF+CMR10" and a[5] == 12 and a[7:] == (110.0, 82.4, 119.0, 94.4)
    x, y = [g for g in glyphs if g[1] == 1]
    assert abs(y[7] - x[9] - 6) < 1e-6  # half an em between
    assert [r[7:] for r in first if r[0] == "vector"] == [(100.0, 141.5, 140.0, 142.0), (10.0, 782.0, 60.0, 782.0)]
    assert [r[7:] for r in first if r[0] == "image"] == [(200.0, 472.0, 230.0, 492.0)]
    assert [(w, h, r[3]) for p, w, h, r in rows if p == 1] == [(100.0, 100.0, "B")]
    assert {p for p, *_ in P.page_rows(document(), 1)[0]} == {1} and {p for p, *_ in P.page_rows(document(), 0, 1)[0]} == {0}


def test_object_streams_and_broken_files():
    inner = b"<< /Type /Catalog /Pages 2 0 R >>"
    packed = b"%PDF-1.5\n" + document(two=False).split(b"\n", 1)[1].replace(b"1 0 obj\n" + inner + b"\nendobj\n", b"")
    packed += b"20 0 obj\n" + stream(b"1 0 " + inner, b"/Type /ObjStm /N 1 /First 4") + b"\nendobj\n"
    assert len(P.page_rows(packed)[0]) == len(P.page_rows(document(two=False))[0]) > 10
    assert P.page_rows(b"") == ([], []) and P.page_rows(b"nonsense") == ([], [])
    assert P.page_rows(document() + b"<< /Encrypt 1 0 R >>")[1] == ["encrypted"]
    assert P.page_rows(document().replace(b"/Filter /FlateDecode", b"/Filter /DCTDecode"))[1] == ["filter:DCTDecode"]
    cut = document().replace(b"/Length", b"/Lenght")
    assert len(P.page_rows(cut)[0]) == len(P.page_rows(document())[0])


def test_strings_and_values():
    assert P._string(b"a\\)(b)\\101\\\n) rest", 0) == (b"a)(b)A", 13)
    assert P.value(b" << /A [1 2 0 R (x)] /B << /C -.5 >> /D true /E#20F <4a4B5> >> ")[0] == {"A": [1, 2, b"x"], "B": {"C": -0.5}, "D": True, "E F": b"JKP"}
    assert P.value(b"7 0 R")[0] == P.Ref(7) and isinstance(P.value(b"7 0 R")[0], P.Ref) and P.value(b"[1 0 R 2 0 R]")[0] == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(document())
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    got = P.pdf_pages(spark, str(tmp_path)).collect()
    assert {r.path[-5:] for r in got if r.page_num is not None} == {"a.pdf"} and [r.warnings for r in got if r.path.endswith("b.pdf")] == ["no_pages"]
    assert {(r.page_num, r.kind) for r in got if r.path.endswith("a.pdf")} == {(0, "glyph"), (0, "vector"), (0, "image"), (1, "glyph")}
