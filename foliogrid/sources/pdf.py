"""Pages of PDF files as tables of glyphs, marks and images, read from the bytes.

A small reader of what typeset papers are made of: plain and compressed objects, Flate streams, page trees with inherited resources, simple and two-byte fonts with
their widths and ToUnicode maps, text and path operators. Encrypted files and other filters give no rows but a warning. Boxes are in points from the top left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(<<|>>|\[|\])|(\()|<([0-9A-Fa-f\s]*)>|/([^\s/<>\[\]()%{}]*)|([+-]?(?:\d+\.?\d*|\.\d+))(?![^\s/<>\[\]()%])|([^\s/<>\[\]()%{}]+)|([{}])")
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Of a font without metrics, how far its glyphs reach above and below the line, and how wide they are.
ASCENT, DESCENT, WIDTH = 0.8, -0.2, 500.0


class Name(str):
    """A name, as opposed to a string."""


class Ref(int):
    """A reference to an object."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The text of a literal string whose bracket opens before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            n = data[at : at + 1]
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            at += 1
            if n == b"\r" and data[at : at + 1] == b"\n":
                at += 1
            out += b"" if n in (b"\r", b"\n") else _ESCAPES.get(n, n)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value, end) of each token: numbers, names, strings as bytes, brackets and operators as text."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if m[1]:
            yield m[1].decode(), at
        elif m[2]:
            value, at = _string(data, at)
            yield value, at
        elif m[3] is not None:
            digits = re.sub(rb"\s", b"", m[3])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif m[4] is not None:
            yield Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[4].decode("latin-1"))), at
        elif m[5]:
            text = m[5].decode()
            yield (float(text) if "." in text else int(text)), at
        elif m[6]:
            yield m[6].decode("latin-1"), at


def value(data: bytes, at: int = 0) -> tuple[object, int]:
    """The object that starts at ``at``, and its end."""
    stack: list[list] = []
    kinds: list[str] = []
    end = at
    it = tokens(data, at)
    for t, end in it:
        if isinstance(t, str) and not isinstance(t, Name):
            if t in ("<<", "["):
                stack.append([])
                kinds.append(t)
                continue
            if t in (">>", "]"):
                if not stack:
                    return None, end
                items = stack.pop()
                kinds.pop()
                t = dict(zip(items[::2], items[1::2], strict=False)) if t == ">>" else items
            elif t == "R" and stack and len(stack[-1]) >= 2:
                stack[-1].pop()
                t = Ref(stack[-1].pop())
            else:
                t = {"true": True, "false": False, "null": None}.get(t, t)
        if not stack:
            if isinstance(t, int) and not isinstance(t, bool) and (m := _REFERENCE.match(data, end - len(str(t)))):
                return Ref(t), m.end()
            return t, end
        stack[-1].append(t)
    return None, end


class Document:
    """Objects of a file, found by their heads, so that a broken table of places does no harm."""

    def __init__(self, data: bytes):
        self.data, self.places, self.packed, self.warnings = data, {}, {}, set()
        for m in _OBJECT.finditer(data):
            self.places[int(m[1])] = m.end()  # the last one of a number counts
        if b"/Encrypt" in data:
            self.warnings.add("encrypted")
            self.places = {}
        for number in list(self.places):
            head = data[self.places[number] : self.places[number] + 400]
            if b"/ObjStm" in head:
                self._unpack(number)

    def _unpack(self, number: int) -> None:
        about, body = self.stream(number)
        if not isinstance(about.get("N"), int) or not body:
            return
        numbers = [t for t, _ in tokens(body[: int(about.get("First", 0))]) if isinstance(t, int)]
        for n, at in zip(numbers[::2], numbers[1::2], strict=False):
            self.packed.setdefault(n, value(body, int(about["First"]) + at)[0])

    def get(self, x: object) -> object:
        seen = 0
        while isinstance(x, Ref) and seen < 32:
            x, seen = (value(self.data, self.places[x])[0] if x in self.places else self.packed.get(int(x))), seen + 1
        return x

    def dictionary(self, x: object) -> dict:
        x = self.get(x)
        return x if isinstance(x, dict) else {}

    def stream(self, number: int) -> tuple[dict, bytes]:
        """The dictionary and the plain bytes of a stream."""
        if number not in self.places:
            return {}, b""
        about, end = value(self.data, self.places[number])
        if not isinstance(about, dict):
            return {}, b""
        m = re.compile(rb"\s*stream\r?\n?").match(self.data, end)
        if not m:
            return about, b""
        length = self.get(about.get("Length"))
        stop = m.end() + length if isinstance(length, int) and self.data[m.end() + length : m.end() + length + 12].lstrip().startswith(b"endstream") else self.data.find(b"endstream", m.end())
        body = self.data[m.end() : stop if stop >= 0 else len(self.data)]
        filters = self.get(about.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) != "FlateDecode":
                self.warnings.add(f"filter:{self.get(f)}")
                return about, b""
            unpack = zlib.decompressobj()
            try:
                body = unpack.decompress(body) + unpack.flush()
            except zlib.error:
                self.warnings.add("broken_stream")
                return about, b""
        return about, body

    def pages(self) -> list[tuple[dict, dict]]:
        """(page, inherited entries) in order."""
        roots = [x for x in (self.dictionary(Ref(n)) for n in [*self.places, *self.packed]) if x.get("Type") == "Catalog"]
        out, seen = [], set()

        def walk(ref: object, held: dict) -> None:
            if isinstance(ref, Ref):
                if ref in seen:
                    return
                seen.add(ref)
            node = self.dictionary(ref)
            held = held | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, held)
            elif node:
                out.append((node, held))

        for root in roots[-1:]:
            walk(root.get("Pages"), {})
        return out


class Font:
    """Codes of a font with their texts and widths."""

    def __init__(self, doc: Document, ref: object):
        d = doc.dictionary(ref)
        self.name = str(doc.get(d.get("BaseFont")) or "")
        self.wide = d.get("Subtype") == "Type0"
        self.texts: dict[int, str] = {}
        if isinstance(d.get("ToUnicode"), Ref):
            self._map(doc.stream(d["ToUnicode"])[1])
        first, widths = doc.get(d.get("FirstChar")) or 0, doc.get(d.get("Widths")) or []
        self.widths = {first + i: float(doc.get(w) or 0) for i, w in enumerate(widths)} if isinstance(widths, list) else {}
        self.default = WIDTH
        below = doc.get(d.get("DescendantFonts"))
        if self.wide and isinstance(below, list) and below:
            cid = doc.dictionary(below[0])
            self.default = float(doc.get(cid.get("DW")) or 1000)
            w, i = doc.get(cid.get("W")) or [], 0
            while i + 1 < len(w):
                a, b = doc.get(w[i]), doc.get(w[i + 1])
                if isinstance(b, list):
                    self.widths |= {a + k: float(doc.get(x) or 0) for k, x in enumerate(b)}
                    i += 2
                else:
                    self.widths |= {k: float(doc.get(w[i + 2]) or 0) for k in range(a, min(b, a + 65_535) + 1)} if i + 2 < len(w) else {}
                    i += 3
        encoding = doc.get(d.get("Encoding"))
        self.names: dict[int, str] = {}
        if isinstance(encoding, dict) and isinstance(doc.get(encoding.get("Differences")), list):
            code = 0
            for x in doc.get(encoding["Differences"]):
                if isinstance(x, int):
                    code = x
                else:
                    self.names[code] = str(x)
                    code += 1

    def _map(self, body: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
        held: list[object] = []
        kind = ""
        for t, _ in tokens(body):
            if t in ("beginbfchar", "beginbfrange"):
                held, kind = [], str(t)
            elif t == "endbfchar":
                self.texts |= {int.from_bytes(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif t == "endbfrange":
                i = 0
                while i + 2 < len(held):
                    a, b = int.from_bytes(held[i]), int.from_bytes(held[i + 1])
                    if held[i + 2] == "[":
                        stop = held.index("]", i + 2)
                        self.texts |= {a + k: text(x) for k, x in enumerate(held[i + 3 : stop]) if isinstance(x, bytes)}
                        i = stop + 1
                        continue
                    first = text(held[i + 2])
                    self.texts |= {a + k: first[:-1] + chr(ord(first[-1]) + k) for k in range(min(b - a, 65_535) + 1) if first}
                    i += 3
            elif kind and isinstance(t, (bytes, str)):
                held.append(t)

    def glyphs(self, raw: bytes) -> Iterator[tuple[str, float, str]]:
        """(text, width in thousandths, glyph name); without a text a code is ``cid:N``."""
        step = 2 if self.wide else 1
        for i in range(0, len(raw) - step + 1, step):
            code = int.from_bytes(raw[i : i + step])
            plain = "" if self.wide or not 32 <= code < 127 or code in self.names else chr(code)
            yield self.texts.get(code, plain) or f"cid:{code}", self.widths.get(code, self.default), self.names.get(code, "")


def _times(a: tuple, b: tuple) -> tuple:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _at(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
Row = tuple[str, int, int, str, str, float, str, float, float, float, float]


class Painter:
    """What a page's operators put where: (kind, line, idx, text, font, size, glyph name, x0, y0, x1, y1)."""

    def __init__(self, doc: Document, resources: dict, box: list[float]):
        self.doc, self.box, self.rows = doc, box, []
        self.fonts = {k: Font(doc, v) for k, v in doc.dictionary(resources.get("Font")).items()}
        self.images = {k for k, v in doc.dictionary(resources.get("XObject")).items() if isinstance(v, Ref) and doc.stream(v)[0].get("Subtype") == "Image"}
        self.line, self.idx, self.last = -1, 0, None

    def put(self, kind: str, corners: list[tuple[float, float]], text: str = "", font: str = "", size: float = 0.0, name: str = "", line: int = -1, idx: int = 0) -> None:
        xs, ys = [c[0] - self.box[0] for c in corners], [self.box[3] - c[1] for c in corners]
        self.rows.append((kind, line, idx, text, font, round(size, 6), name, *(round(v, 4) for v in (min(xs), min(ys), max(xs), max(ys)))))

    def show(self, raw: bytes) -> None:
        s = self.state
        font = self.fonts.get(s["font"])
        for text, width, name in font.glyphs(raw) if font else ():
            m = _times((s["size"] * s["scale"], 0, 0, s["size"], 0, s["rise"]), _times(self.tm, s["ctm"]))
            size = abs(m[3]) or abs(m[1])
            base = _at(m, 0, 0)
            # a line goes on while glyphs follow on about one height
            if self.last is None or abs(base[1] - self.last[1]) > 0.5 * max(size, self.last[2]) or base[0] < self.last[0] - 2 * size or base[0] > self.last[0] + 4 * size:
                self.line, self.idx = self.line + 1, 0
            self.put("glyph", [_at(m, 0, DESCENT), _at(m, width / 1000, ASCENT)], text, font.name, size, name, self.line, self.idx)
            self.idx += 1
            ahead = (width / 1000 * s["size"] + s["spacing"] + (s["words"] if text == " " else 0)) * s["scale"]
            self.tm = _times((1, 0, 0, 1, ahead, 0), self.tm)
            self.last = (*_at(m, width / 1000, 0), size)

    def move(self, x: float, y: float) -> None:
        self.tm = self.lm = _times((1, 0, 0, 1, x, y), self.lm)

    def run(self, body: bytes) -> None:
        self.state = {"ctm": _ONE, "font": "", "size": 1.0, "spacing": 0.0, "words": 0.0, "scale": 1.0, "leading": 0.0, "rise": 0.0}
        self.tm = self.lm = _ONE
        kept: list[dict] = []
        held: list = []
        path: list[tuple[float, float]] = []
        number = {"Tc": "spacing", "Tw": "words", "TL": "leading", "Ts": "rise"}
        for t, _ in tokens(body):
            if not isinstance(t, str) or isinstance(t, Name) or t in ("[", "]", "<<", ">>"):
                held.append(t)
                continue
            s, n = self.state, [x for x in held if isinstance(x, (int, float))]
            if t == "q":
                kept.append(dict(s))
            elif t == "Q" and kept:
                self.state = kept.pop()
            elif t == "cm" and len(n) == 6:
                s["ctm"] = _times(tuple(n), s["ctm"])
            elif t == "BT":
                self.tm = self.lm = _ONE
            elif t == "Tf" and n:
                s["font"], s["size"] = next((x for x in held if isinstance(x, Name)), ""), float(n[-1])
            elif t in number and n:
                s[number[t]] = float(n[-1])
            elif t == "Tz" and n:
                s["scale"] = n[-1] / 100
            elif t in ("Td", "TD") and len(n) >= 2:
                s["leading"] = -n[1] if t == "TD" else s["leading"]
                self.move(n[0], n[1])
            elif t == "Tm" and len(n) == 6:
                self.tm = self.lm = tuple(map(float, n))
            elif t == "T*":
                self.move(0, -s["leading"])
            elif t in ("Tj", "TJ", "'", '"'):
                if t in ("'", '"'):
                    if t == '"' and len(n) >= 2:
                        s["words"], s["spacing"] = float(n[0]), float(n[1])
                    self.move(0, -s["leading"])
                for x in held:
                    if isinstance(x, bytes):
                        self.show(x)
                    elif isinstance(x, (int, float)) and t == "TJ":
                        self.tm = _times((1, 0, 0, 1, -x / 1000 * s["size"] * s["scale"], 0), self.tm)
            elif t in ("m", "l", "c", "v", "y") and len(n) >= 2:
                path += [_at(s["ctm"], *n[i : i + 2]) for i in range(0, len(n) - 1, 2)]
            elif t == "re" and len(n) == 4:
                path += [_at(s["ctm"], n[0], n[1]), _at(s["ctm"], n[0] + n[2], n[1] + n[3])]
            elif t in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
                if path:
                    self.put("vector", path)
                path = []
            elif t == "n":
                path = []
            elif t == "Do" and held and held[-1] in self.images:
                self.put("image", [_at(s["ctm"], 0, 0), _at(s["ctm"], 1, 1)])
            held = []


def page_rows(data: bytes, first: int = 0, pages: int | None = None) -> tuple[list[tuple[int, float, float, Row]], list[str]]:
    """((page, width, height, row) of a file's pages, warnings)."""
    doc, out = Document(data), []
    for number, (page, held) in enumerate(doc.pages()):
        if number < first or (pages and number >= first + pages):
            continue
        box = [float(doc.get(x)) for x in (doc.get(held.get("MediaBox")) or [0, 0, 612, 792])]
        contents = doc.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page.get("Contents")]
        painter = Painter(doc, doc.dictionary(held.get("Resources")), box)
        painter.run(b"\n".join(doc.stream(r)[1] for r in refs if isinstance(r, Ref)))
        out += [(number, box[2] - box[0], box[3] - box[1], row) for row in painter.rows]
    return out, sorted(doc.warnings)


_COLUMNS = "page_num int, width double, height double, kind string, line int, idx int, text string, font string, size double, glyph_name string, x0 double, y0 double, x1 double, y1 double, warnings string"


def pdf_pages(spark: SparkSession, path: str, first: int = 0, pages: int | None = None) -> DataFrame:
    """(path, page_num, width, height, kind, line, idx, text, font, size, glyph_name, box, warnings) of PDF files: glyphs, marks (``vector``) and images.

    A file is one row of Spark's binary reader and is read in one task. A file that can't be read has one row with its warnings and no page.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *[c.split(" ")[0] for c in _COLUMNS.split(", ")]]
        for part in parts:
            for where, content in zip(part["path"], part["content"], strict=True):
                rows, warnings = page_rows(bytes(content), first, pages)
                told = ",".join(warnings)
                table = [(where, p, w, h, *row, told) for p, w, h, row in rows] or [(where, *[None] * 14, told or "no_pages")]
                yield pd.DataFrame(table, columns=names).astype({"page_num": "Int32", "line": "Int32", "idx": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, f"path string, {_COLUMNS}")
