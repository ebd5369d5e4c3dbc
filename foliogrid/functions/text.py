"""Scalar text functions as Spark SQL expressions: each takes the SQL of its arguments and gives SQL."""

from __future__ import annotations

#: Words that retrieval leaves out.
STOP_WORDS = (
    "a an and are as at be by can do does for from how in into is it its of on or that the their this to was what when where which why with"
).split()
#: Macros that are written out before formulas are compared, in order.
MACROS = {
    r"\dmodel": r"d_{\text{model}}",
    r"\dff": r"d_{\text{ff}}",
    r"\dffn": r"d_{\text{ffn}}",
    r"\vec": r"\mathbf",
    r"\mbf": r"\mathbf",
    r"\mc": r"\mathcal",
    r"\RR": r"\mathbb{R}",
    r"\CC": r"\mathbb{C}",
    r"\ZZ": r"\mathbb{Z}",
    r"\QQ": r"\mathbb{Q}",
    r"\NN": r"\mathbb{N}",
    r"\kp": r"\mathfrak{p}",
    r"\kq": r"\mathfrak{q}",
    r"\km": r"\mathfrak{m}",
    r"\OO": r"\mathcal{O}",
    r"\AA": r"\mathcal{A}",
    r"\BB": r"\mathcal{B}",
    r"\VV": r"\mathcal{V}",
}
#: Greek letters by what they count as in comparisons, in order.
GREEK = {"alpha": "a", "beta": "b", "gamma": "g", "delta": "d", "epsilon": "e", "theta": "theta", "lambda": "lambda", "mu": "mu", "pi": "pi", "sigma": "sigma", "phi": "phi", "omega": "omega", "xi": "xi", "tau": "tau"}
#: What marks a text as mathematical, its ranges of characters, and its fonts by a part of their name.
MATH_MARKERS = "=+-*/^_()[]{}∈≤≥×·√∑∫→"
MATH_RANGES = ((0x2200, 0x22FF), (0x27C0, 0x27EF), (0x2980, 0x29FF), (0x2A00, 0x2AFF), (0x1D400, 0x1D7FF))
MATH_FONTS = ("cm", "math", "symbol", "cambria", "stix", "xits", "tex")
#: What shows that a title was decoded wrongly, and words of formulas that stand alone in titles.
MOJIBAKE = ("\ufffd", "Ã", "Â", "â€", "鈥", "锛", "鍙", "鐨", "绗", "鏂", "瀹", "瑙", "鐩")  # longer ones begin with "â€"
FRAGMENTS = "arccos arccot arcsin arctan cos cot csc curl det div grad lim ln log max min sec sin tan".split()
#: Warnings that ask for the precise round.
IMPRECISE = ("low_confidence", "empty_latex", "review", "review_only", "needs_review", "unknown_glyph", "missing_tounicode", "table_or_text_like_region", "tabular_alignment")
LEAST_SCORE = 0.65


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex_replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {literal(pattern)}, {literal(by)})"


def collapsed(x: str) -> str:
    """Runs of white space as one blank, none at the ends."""
    return f"trim({regex_replace(x, r'[ \t\n\r\f\v]+', ' ')})"


def base_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9_]+|[\\u4e00-\\u9fff]', 0)"


def token_count(x: str) -> str:
    return f"regexp_count(lower({x}), '[a-z0-9_]+|[\\u4e00-\\u9fff]')"


def variants(t: str) -> str:
    """Simple English word forms of an ASCII token, as an array."""
    short = f"case when length({t}) > 4 and endswith({t}, 'ies') then array(concat(left({t}, length({t}) - 3), 'y')) when length({t}) > 4 and endswith({t}, 's') then array(left({t}, length({t}) - 1)) else array() end"
    ing = f"case when length({t}) > 5 and endswith({t}, 'ing') then array(left({t}, length({t}) - 3), concat(left({t}, length({t}) - 3), 'e')) else array() end"
    ed = f"case when length({t}) > 4 and endswith({t}, 'ed') then array(left({t}, length({t}) - 2)) else array() end"
    return f"concat({short}, {ing}, {ed})"


def retrieval_tokens(x: str) -> str:
    """Tokens without stop words, each ASCII one followed by its variants."""
    stop = ", ".join(literal(w) for w in STOP_WORDS)
    kept = f"filter({base_tokens(x)}, t -> t not in ({stop}))"
    return f"flatten(transform({kept}, t -> concat(array(t), case when t rlike '^[a-z0-9_]+$' then {variants('t')} else array() end)))"


def bigrams(tokens: str) -> str:
    return f"transform(slice({tokens}, 2, greatest(size({tokens}) - 1, 0)), (next_token, i) -> concat({tokens}[i], '_', next_token))"


def cleaned(x: str) -> str:
    """Hyphenation across lines undone, single newlines as blanks, blanks collapsed."""
    x = regex_replace(x, r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")
    x = regex_replace(x, r"(?<!\n)\n(?!\n)", " ")
    return f"trim({regex_replace(x, r'[ \t]+', ' ')})"


def formula_normal(x: str) -> str:
    """A formula in the spelling in which formulas are compared. The patterns below and their order."""
    x = f"replace({x}, '−', '-')"
    for sign, macro in (("·", r"\cdot"), ("∈", r"\in"), ("×", r"\times")):
        x = f"replace({x}, '{sign}', {literal(macro)})"
    for macro, written in MACROS.items():
        x = f"replace({x}, {literal(macro)}, {literal(written)})"
    x = regex_replace(x, r"\\(?:mathrm|operatorname\*?|text|mathbf|mathbb|mathcal|mathfrak)\s*\{([^{}]*)\}", "$1")
    x = regex_replace(x, r"\\(?:left|right|big|Big|bigg|Bigg)\b")
    x = regex_replace(x, r"\\(?:tiny|small|qquad|quad)\b")
    x = regex_replace(x, r"\\[,;! ]")
    for name, value in GREEK.items():
        x = f"replace({x}, {literal('\\' + name)}, '{value}')"
    x = regex_replace(x, r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "$1/$2")
    x = regex_replace(x, r"\\sqrt\s*\{([^{}]+)\}", "sqrt$1")
    x = f"lower({regex_replace(x, r'\\[A-Za-z]+')})"
    return regex_replace(x, r"[^a-z0-9=+\-*/^_(){}\[\].,|<>:]+")


def match_tokens(normal: str, parts: bool = False) -> str:
    """Words, numbers and leading 4, 6 and 8 characters of a normal formula, distinct and sorted; ``parts``: also what stands between blanks."""
    compact = regex_replace(normal, r"[_{}]")
    heads = ", ".join(f"case when length({compact}) >= {n} then left({compact}, {n}) end" for n in (4, 6, 8))
    more = f", filter(split(replace({compact}, {literal(chr(92))}, ''), '\\\\s+'), w -> w <> '')" if parts else ""
    return f"array_sort(array_distinct(concat(regexp_extract_all({normal}, '[a-z]{{2,}}|[0-9]+', 0), array_compact(array({heads})){more})))"


def count_of(x: str, characters: str) -> str:
    """How many of the characters stand in the text."""
    return f"(length({x}) - length(translate({x}, {literal(characters)}, '')))"


def occurrences(x: str, part: str) -> str:
    """How often a string stands in the text."""
    return f"cast((length({x}) - length(replace({x}, {literal(part)}, ''))) / {len(part)} as int)"


def is_math_wrapped(x: str) -> str:
    return f"(startswith(trim({x}), '$') or startswith(trim({x}), {literal('\\[')}) or startswith(trim({x}), {literal('\\(')}))"


def wrapped_math(x: str, display: bool = True) -> str:
    a, b = ("$$\n", "\n$$") if display else ("\\(", "\\)")
    return f"case when trim({x}) = '' or {is_math_wrapped(x)} then trim({x}) else concat({literal(a)}, trim({x}), {literal(b)}) end"


def index_text(kind: str, content: str, shadowed: str) -> str:
    """What the indexes see of a block."""
    return f"case when coalesce({shadowed}, '') <> '' then '' when {kind} = 'formula' then {wrapped_math(content)} else coalesce({content}, '') end"


def preview(x: str, limit: int) -> str:
    flat = collapsed(f"coalesce({x}, '')")
    return f"case when length({flat}) <= {limit} then {flat} else concat(rtrim(left({flat}, {limit - 1})), '...') end"


def stable_token(x: str) -> str:
    return f"left(sha1(lower({collapsed(f"coalesce({x}, '')")})), 16)"


def review_complexity(x: str) -> str:
    """Capped counts of what makes a formula hard to review."""
    bare = f"trim(replace(replace(replace(replace(trim({x}), {literal('\\(')}, ''), {literal('\\)')}, ''), '$$', ''), '$', ''))"
    parts = [
        f"least(length({bare}) / 18.0D, 2.0D)",
        f"least({count_of(bare, '\\')} * 0.35D, 1.4D)",
        f"least({count_of(bare, '0123456789')} * 0.18D, 0.9D)",
        f"least({count_of(bare, '_^{}[]()')} * 0.14D, 1.2D)",
        f"least({count_of(bare, '+-=<>/|,')} * 0.12D, 1.0D)",
        f"case when {bare} rlike '[^\\\\x00-\\\\x7F]' then 0.5D else 0.0D end",
    ]
    return f"case when {bare} = '' then 0.0D else bround({' + '.join(parts)}, 3) end"


def translation_budget(x: str) -> str:
    return f"least(2048, greatest(192, cast(floor(length({x}) * 1.8D) as int) + 96))"


def is_passthrough(x: str) -> str:
    """Texts that are shown as they are rather than translated."""
    t = f"trim({x})"
    mathish = f"regexp_count({t}, {literal('[=+\\-*/^_{}\\\\()\\[\\]<>∑∫√≤≥≈∞]')})"
    few = f"length({t}) <= 80 and regexp_count({t}, '[A-Za-z]') <= 8 and {mathish} >= greatest(1, length({t}) div 5)"
    return f"(length({t}) <= 3 or {t} rlike '[\\u4e00-\\u9fff]' or ({few}))"


def font_name(x: str) -> str:
    """A font's name without its subset prefix."""
    return regex_replace(f"trim({x})", r"^[A-Z]{6}\+")


def font_family(x: str) -> str:
    """A font's name without a prefix of eight characters at most, and without blanks: the data sets' variant."""
    return f"replace({regex_replace(x, r'^[^+]{0,8}\+')}, ' ', '')"


def unknown_glyph(x: str) -> str:
    """Glyphs whose character isn't known: nothing, the replacement character, or a bare code."""
    return f"({x} in ('', '\ufffd') or left({x}, 4) = 'cid:')"


def needs_precision(warnings: str, score: str) -> str:
    """Results that the precise round looks at again; ``warnings``: an array."""
    listed = ", ".join(f"'{w}'" for w in IMPRECISE)
    return f"(arrays_overlap(transform({warnings}, w -> lower(w)), array({listed})) or coalesce({score}, 1.0D) < {LEAST_SCORE}D)"


def pending_formula(kind: str, needs_ocr: str, recognised: str) -> str:
    """Formula blocks that wait for recognition."""
    return f"({kind} = 'formula' and coalesce({needs_ocr}, false) and not coalesce({recognised}, false))"


def backend_skip(model: str, available: str) -> str:
    """Why a review's backend is passed over; nothing if it isn't."""
    name = f"trim(coalesce({model}, ''))"
    reason = f"case when {name} = '' then 'empty_model' when lower({name}) = 'mock' then concat('mock_model=', {name}) when not coalesce({available}, false) then concat('model=', {name}) end"
    return f"coalesce(concat('semantic_review_backend_unavailable:', {reason}), '')"


def evidence_block(source: str, label: str, page: str, kind: str, section: str, content: str) -> str:
    """A source as it stands in a question's context."""
    return f"concat('[', {source}, '] ', {label}, ' · 第', {page} + 1, '页 · ', {kind}, if(coalesce({section}, '') = '', '', concat(' · ', {section})), '\\n', {content})"


#: Coverage tags of a formula's LaTeX by what it contains.
COVERAGE = {
    "subscript": ["_"],
    "superscript": ["^"],
    "fraction": [r"\frac", r"\dfrac", r"\tfrac"],
    "radical": [r"\sqrt"],
    "accent_or_overline": [r"\bar", r"\overline", r"\widehat", r"\hat", r"\tilde", r"\vec"],
    "large_operator": [r"\sum", r"\prod", r"\lim", r"\int", r"\bigcup", r"\bigcap"],
    "matrix_or_array": [r"\begin{matrix", r"\begin{pmatrix", r"\begin{bmatrix", r"\begin{array"],
    "cases": [r"\begin{cases"],
    "alignment": [r"\begin{align", r"\begin{aligned", r"\begin{gather", r"\begin{split"],
    "math_alphabet": [r"\mathbb", r"\mathcal", r"\mathfrak", r"\mathbf", r"\bm", r"\boldsymbol"],
    "text_run": [r"\text", r"\mathrm", r"\operatorname"],
}


def coverage_tags(x: str, kind: str | None = None, rule: str | None = None, script: str | None = None, math: str | None = None, inked: str | None = None) -> str:
    """Sorted tags of what a formula's LaTeX exercises, and of what is known of its glyphs and marks.

    ``kind``: the formula's; ``rule``, ``script``, ``math``: whether it has a horizontal rule, glyphs of script size, of mathematical fonts; ``inked``: its glyphs with ink.
    """
    known = [(rule, "horizontal_rule"), (script, "script_size_pdf_evidence"), (math, "math_font_pdf_evidence"), (inked and f"{inked} <= 1", "single_glyph_or_empty_text")]
    tags = [f"case when {test} then '{tag}' end" for test, tag in known if test] + ([f"nullif({kind}, '')"] if kind else [])
    tags += [f"case when {' or '.join(f'contains({x}, {literal(p)})' for p in parts)} then '{tag}' end" for tag, parts in COVERAGE.items()]
    tags.append(f"case when contains({x}, '_') and contains({x}, '^') then 'subsup' end")
    return f"array_sort(array_distinct(array_compact(array({', '.join(tags)}))))"


def looks_like_latex(x: str) -> str:
    t = f"trim({x})"
    return f"({t} <> '' and {occurrences(t, '{')} = {occurrences(t, '}')} and {occurrences(t, '[')} = {occurrences(t, ']')})"
