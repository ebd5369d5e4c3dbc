"""LaTeX as text: spans of mathematics, formulas kept out of translation, macros written out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Environments whose body is display mathematics, inline mathematics, and none.
DISPLAY = "equation equation* align align* alignat alignat* gather gather* multline multline* flalign flalign* eqnarray eqnarray* split cases displaymath IEEEeqnarray".split()
INLINE = ["math"]
SKIPPED = "asy asydef verbatim Verbatim lstlisting minted comment filecontents filecontents*".split()

#: What a scanner meets: any escaped character is one token, so a delimiter is never seen behind a backslash.
_TOKEN = re.compile(r"\\begin\s*\{([^{}]+)\}|\\endinput(?![^\W\d_])|\\.|\$\$|[$%{}]|\n", re.DOTALL)


def math_spans(text: str) -> list[tuple[str, str, int, int, int, int, str]]:
    """(kind, body, body start, body end, start, end, environment or delimiter) of each span, in order.

    Comments and skipped environments hold no spans; ``\\endinput`` ends the text; an opening that is never closed is
    ordinary text. A single dollar closes at the next one outside braces.
    """
    tokens = list(_TOKEN.finditer(text))
    out, i, skip_to = [], 0, 0
    commented, limit = False, len(text)
    for t in tokens:
        commented = t[0] != "\n" and (commented or t[0] == "%")
        if t[0] == "\\endinput" and not commented:
            limit = t.start()
            break

    def close_at(k: int, wanted: str) -> re.Match | None:
        return next((t for t in tokens[k:] if t[0] == wanted), None)

    def close_env(k: int, name: str) -> tuple[int, int] | None:
        for t in re.finditer(r"\\end\{" + re.escape(name) + r"\}", text[tokens[k].end() :]):
            at = tokens[k].end() + t.start()
            behind = re.search(r"\\*$", text[:at])[0]
            if len(behind) % 2 == 0:
                return at, at + len(t[0])
        return None

    def dollar(k: int) -> int:
        """Where a single dollar closes; the second one of two does, if no third follows."""
        depth = 0
        for t in tokens[k:]:
            if t[0] == "{":
                depth += 1
            elif t[0] == "}":
                depth = max(0, depth - 1)
            elif t[0][0] == "$" and not depth and text[t.end() : t.end() + 1] != "$":
                return t.end() - 1
        return -1

    while i < len(tokens):
        t = tokens[i]
        i += 1
        if t.start() >= limit:
            break
        if t.start() < skip_to:
            continue
        if t[0] == "%":
            end = text.find("\n", t.end())
            skip_to = len(text) if end < 0 else end
        elif t[1]:
            found = close_env(i - 1, t[1]) if t[1] in DISPLAY or t[1] in INLINE or t[1] in SKIPPED else None
            if found:
                skip_to = found[1]
                if t[1] not in SKIPPED:
                    out.append(("display" if t[1] in DISPLAY else "inline", text[t.end() : found[0]], t.end(), found[0], t.start(), found[1], t[1]))
        elif t[0] in ("\\[", "\\(", "$$") and (shut := close_at(i, {"\\[": "\\]", "\\(": "\\)", "$$": "$$"}[t[0]])):
            skip_to = shut.end()
            out.append(("inline" if t[0] == "\\(" else "display", text[t.end() : shut.start()], t.end(), shut.start(), t.start(), shut.end(), t[0]))
        elif t[0] in ("$$", "$") and (end := dollar(i)) >= 0 and text[t.end() : t.end() + 1] != "$":
            # two dollars that never close leave the second one to open
            skip_to = end + 1
            out.append(("inline", text[t.end() : end], t.end(), end, t.end() - 1, end + 1, "$"))
    return out


SPAN = "array<struct<kind:string,body:string,body_start:int,body_end:int,start:int,end:int,delimiter:string>>"


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """A row for each span of each row's text, under ``span``."""

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        names = ("kind", "body", "body_start", "body_end", "start", "end", "delimiter")
        return texts.map(lambda t: [dict(zip(names, s, strict=True)) for s in math_spans(t or "")])

    return df.withColumn("span", F.explode(run(text)))


#: Formulas that translations leave alone, in order, and the delimiters that they come back in.
_SHELTERED = [
    (re.compile(r"\\\[(.+?)\\\]", re.DOTALL), "$$", "$$"),
    (re.compile(r"\$\$(.+?)\$\$", re.DOTALL), "$$", "$$"),
    (re.compile(r"\\\((.+?)\\\)"), "\\(", "\\)"),
    (re.compile(r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"), "\\(", "\\)"),
]


def shelter(text: str) -> tuple[str, list[str]]:
    """The text with numbered placeholders for its formulas, and the formulas in order of their numbers."""
    kept: list[str] = []
    for pattern, a, b in _SHELTERED:

        def take(m: re.Match, a=a, b=b) -> str:
            kept.append(a + m[1].strip() + b)
            return f"【FORMULA_{len(kept) - 1}】"

        text = pattern.sub(take, text)
    return text, kept


def sheltered(text: str) -> Column:
    """``struct<text, formulas>`` of a column."""

    @F.pandas_udf("text string, formulas array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shelter(t or "") for t in texts], columns=["text", "formulas"])

    return run(text)


def restored(text: str, formulas: str) -> Column:
    """The text with its formulas back in their places, last ones first, as they may hold earlier ones; native."""
    return F.expr(f"aggregate(reverse(transform({formulas}, (f, i) -> struct(f, i))), {text}, (t, s) -> replace(t, concat('【FORMULA_', s.i, '】'), s.f))")


_NEW = re.compile(r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?\s*(?:\[(\d)\])?(?:\[([^\]]*)\])?\s*(?=\{)|\\providecommand\*?\s*\{?\\([A-Za-z]+)\}?\s*(?:\[(\d)\])?\s*(?=\{)|\\def\s*\\([A-Za-z]+)((?:#\d)*)\s*(?=\{)|\\DeclareMathOperator(\*?)\s*\{\\([A-Za-z]+)\}\s*(?=\{)")


def _braced(text: str, at: int) -> int:
    """The end of the group that opens at ``at``; -1 if it never closes."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.DOTALL).finditer(text, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if m[0] == "}" and not depth:
            return m.end()
    return -1


def macros_in(text: str) -> dict[str, tuple[int, str | None, str]]:
    """name -> (arguments, default of the first, body) of all definitions; later ones count."""
    out: dict[str, tuple[int, str | None, str]] = {}
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    for m in _NEW.finditer(text):
        end = _braced(text, m.end())
        if end < 0:
            continue
        body = text[m.end() + 1 : end - 1]
        if m[9]:
            out[m[9]] = (0, None, f"\\operatorname{m[8]}{{{body}}}")
        elif m[6]:
            out[m[6]] = (len(m[7]) // 2, None, body)
        elif m[4]:
            out.setdefault(m[4], (int(m[5] or 0), None, body))
        else:
            out[m[1]] = (int(m[2] or 0), m[3], body)
    return out


def expand(text: str, macros: dict[str, tuple[int, str | None, str]], passes: int = 12) -> tuple[str, list[str]]:
    """The text with macros written out, pass by pass, and warnings: what lacks arguments stays; endless ones stop."""
    warnings: set[str] = set()
    for _ in range(passes):
        out, at, changed = [], 0, False
        for m in re.finditer(r"\\([A-Za-z]+)", text):
            if m.start() < at or m[1] not in macros:
                continue
            count, default, body = macros[m[1]]
            p, values = m.end(), []
            if count and default is not None:
                option = re.compile(r"\s*\[([^\]]*)\]").match(text, p)
                values.append(option[1] if option else default)
                p = option.end() if option else p
            while len(values) < count:
                space = re.compile(r"\s*").match(text, p).end()
                end = _braced(text, space) if text[space : space + 1] == "{" else space + 1 if text[space : space + 1].strip() else -1
                if end < 0:
                    break
                values.append(text[space + 1 : end - 1] if text[space] == "{" else text[space])
                p = end
            if len(values) < count:
                warnings.add(f"missing_arguments:{m[1]}")
                continue
            out += [text[at : m.start()], re.sub(r"#(\d)", lambda x, v=values: v[int(x[1]) - 1] if int(x[1]) <= len(v) else x[0], body)]
            if not count and body[-1:].isalpha() and text[p : p + 1].isalpha():
                out.append(" ")
            at, changed = p, True
        if not changed:
            return text, sorted(warnings)
        text = "".join(out) + text[at:]
    return text, sorted(warnings | {"expansion_limit"})


def hashed_embedding(text: str, dimensions: int = 1024) -> Column:
    """Signed feature hashing of words, their 3- and 4-letter parts and pairs, of unit length.

    A token's BLAKE2b of 8 bytes, little-endian, gives its place (rest by dimensions) and sign (top bit); longer tokens weigh more.
    """
    import hashlib

    def tokens(t: str) -> Iterator[str]:
        base = re.findall(r"[a-z0-9_]+|[\u4e00-\u9fff]", t.lower())
        for w in base:
            yield w
            if len(w) >= 6:
                for n in (3, 4):
                    yield from (w[i : i + n] for i in range(len(w) - n + 1))
        yield from (f"{a}_{b}" for a, b in zip(base, base[1:], strict=False))

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for t in texts:
            v = np.zeros(dimensions)
            for w in tokens(t or ""):
                if w not in known:
                    value = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    known[w] = (value % dimensions, (1 + min(len(w), 12) / 12) * (-1 if value >> 63 else 1))
                place, weight = known[w]
                v[place] += weight
            size = np.sqrt((v * v).sum())
            out.append(v / size if size else v)
            if len(known) > 200_000:
                known.clear()
        return pd.Series(out)

    return run(text)
