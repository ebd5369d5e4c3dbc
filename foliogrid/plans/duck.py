"""DuckDB's spelling of the text functions, for the SQL that checks the plans."""

from __future__ import annotations

from foliogrid.functions import text as X


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def collapsed(x: str) -> str:
    return f"trim({sub(x, r'[ \t\n\r\f\v]+', ' ')})"


def tokens(x: str) -> str:
    stop = ", ".join(q(w) for w in X.STOP_WORDS)
    t = "t"
    forms = f"""list_concat(list_concat(
        case when length({t}) > 4 and suffix({t}, 'ies') then [left({t}, length({t}) - 3) || 'y'] when length({t}) > 4 and suffix({t}, 's') then [left({t}, length({t}) - 1)] else [] end,
        case when length({t}) > 5 and suffix({t}, 'ing') then [left({t}, length({t}) - 3), left({t}, length({t}) - 3) || 'e'] else [] end),
        case when length({t}) > 4 and suffix({t}, 'ed') then [left({t}, length({t}) - 2)] else [] end)"""
    return f"flatten(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda t: t not in ({stop})), lambda t: list_concat([t], case when regexp_full_match(t, '[a-z0-9_]+') then {forms} else [] end)))"


def bigrams(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || '_' || {t}[i + 1])"


def cleaned(x: str) -> str:
    x = sub(x, r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", r"\1\2")
    for _ in range(2):  # no look-around here: neighbours that share a character need a second go
        x = sub(x, r"(^|[^\n])\n([^\n]|$)", r"\1 \2")
    return f"trim({sub(x, r'[ \t]+', ' ')})"


def formula_normal(x: str) -> str:
    x = f"replace({x}, '−', '-')"
    for sign, macro in (("·", r"\cdot"), ("∈", r"\in"), ("×", r"\times")):
        x = f"replace({x}, '{sign}', {q(macro)})"
    for macro, written in X.MACROS.items():
        x = f"replace({x}, {q(macro)}, {q(written)})"
    x = sub(x, r"\\(?:mathrm|operatorname\*?|text|mathbf|mathbb|mathcal|mathfrak)\s*\{([^{}]*)\}", r"\1")
    for pattern in (r"\\(?:left|right|big|Big|bigg|Bigg)\b", r"\\(?:tiny|small|qquad|quad)\b", r"\\[,;! ]"):
        x = sub(x, pattern)
    for name, value in X.GREEK.items():
        x = f"replace({x}, {q('\\' + name)}, '{value}')"
    x = sub(x, r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"\1/\2")
    x = sub(x, r"\\sqrt\s*\{([^{}]+)\}", r"sqrt\1")
    x = f"lower({sub(x, r'\\[A-Za-z]+')})"
    return sub(x, r"[^a-z0-9=+\-*/^_(){}\[\].,|<>:]+")


def match_tokens(n: str) -> str:
    compact = sub(n, "[_{}]")
    heads = ", ".join(f"case when length({compact}) >= {k} then left({compact}, {k}) end" for k in (4, 6, 8))
    return f"list_sort(list_distinct(list_concat(regexp_extract_all({n}, '[a-z]{{2,}}|[0-9]+'), list_filter([{heads}], lambda h: h is not null))))"


def count_of(x: str, characters: str) -> str:
    return f"(length({x}) - length(translate({x}, {q(characters)}, '')))"


def occurrences(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(part)}, ''))) // {len(part)})::int"


def wrapped_math(x: str) -> str:
    t = f"trim({x})"
    return f"case when {t} = '' or prefix({t}, '$') or prefix({t}, '\\[') or prefix({t}, '\\(') then {t} else '$$' || chr(10) || {t} || chr(10) || '$$' end"


def preview(x: str, limit: int) -> str:
    flat = collapsed(f"coalesce({x}, '')")
    return f"case when length({flat}) <= {limit} then {flat} else rtrim(left({flat}, {limit - 1})) || '...' end"


def stable_token(x: str) -> str:
    return f"left(sha1(lower({collapsed(f"coalesce({x}, '')")})), 16)"


def complexity(x: str) -> str:
    bare = f"trim(replace(replace(replace(replace(trim({x}), '\\(', ''), '\\)', ''), '$$', ''), '$', ''))"
    parts = [
        f"least(length({bare}) / 18.0::double, 2.0::double)",
        f"least({count_of(bare, '\\')} * 0.35::double, 1.4::double)",
        f"least({count_of(bare, '0123456789')} * 0.18::double, 0.9::double)",
        f"least({count_of(bare, '_^{}[]()')} * 0.14::double, 1.2::double)",
        f"least({count_of(bare, '+-=<>/|,')} * 0.12::double, 1.0::double)",
        f"case when regexp_matches({bare}, '[^\\x00-\\x7F]') then 0.5::double else 0.0::double end",
    ]
    return f"case when {bare} = '' then 0.0::double else round_even({' + '.join(parts)}, 3) end"


def passthrough(x: str) -> str:
    t = f"trim({x})"
    mathish = f"len(regexp_extract_all({t}, {q('[=+\\-*/^_{}\\\\()\\[\\]<>∑∫√≤≥≈∞]')}))"
    return f"(length({t}) <= 3 or regexp_matches({t}, '[\\x{{4e00}}-\\x{{9fff}}]') or (length({t}) <= 80 and len(regexp_extract_all({t}, '[A-Za-z]')) <= 8 and {mathish} >= greatest(1, length({t}) // 5)))"


def coverage_tags(x: str) -> str:
    tags = [f"case when {' or '.join(f'contains({x}, {q(p)})' for p in parts)} then '{tag}' end" for tag, parts in X.COVERAGE.items()]
    tags.append(f"case when contains({x}, '_') and contains({x}, '^') then 'subsup' end")
    return f"list_sort(list_filter([{', '.join(tags)}], lambda t: t is not null))"
