"""Text queries: tokens, cleaning, normal forms, predicates and tables of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.functions import text as X
from foliogrid.functions import tokens as K
from foliogrid.plans import duck as D
from foliogrid.plans.base import BLOCKS, FORMULAS, blocks, formulas, query
from foliogrid.session import table


@query("f01_retrieval_tokens", f"with d as (select doc_id, {D.tokens('text')} as t from documents where text is not null) select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5, md5(array_to_string({D.bigrams('t')}, ' ')) as bigrams_md5 from d")
def f01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", K.token_digests("text").alias("t"))
    return d.select("doc_id", F.col("t.n").alias("n_tokens"), F.col("t.tokens").alias("tokens_md5"), F.col("t.bigrams").alias("bigrams_md5"))


@query("f11_clean_text", f"select doc_id, md5({D.cleaned('text')}) as cleaned_md5, length({D.cleaned('text')})::int as n from documents where text is not null")
def f11(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").withColumn("c", F.expr(X.cleaned("text"))).selectExpr("doc_id", "md5(c) as cleaned_md5", "length(c) as n")


@query("f15_formula_normal", f"with {FORMULAS}, n as (select result_id, latex, {D.formula_normal('latex')} as normal from formulas) select result_id, normal, array_to_string({D.match_tokens('normal')}, ' ') as tokens, {D.complexity('latex')} as complexity, array_to_string({D.coverage_tags('latex')}, ',') as tags from n")
def f15(spark, sf_dir):
    n = formulas(spark, sf_dir).withColumn("normal", F.expr(X.formula_normal("latex")))
    return n.selectExpr("result_id", "normal", f"array_join({X.match_tokens('normal')}, ' ') as tokens", f"{X.review_complexity('latex')} as complexity", f"array_join({X.coverage_tags('latex')}, ',') as tags")


@query("f18_compact_latex", rf"with {FORMULAS} select result_id, {D.sub('latex', r'\s')} as compact, (trim(latex) <> '' and {D.occurrences('latex', '{')} = {D.occurrences('latex', '}')} and {D.occurrences('latex', '[')} = {D.occurrences('latex', ']')}) as balanced, {D.wrapped_math('latex')} as wrapped from formulas")
def f18(spark, sf_dir):
    return formulas(spark, sf_dir).selectExpr("result_id", f"{X.regex_replace('latex', r'\s')} as compact", f"{X.looks_like_latex('latex')} as balanced", f"{X.wrapped_math('latex')} as wrapped")


@query("f27_preview_and_tokens", f"with {BLOCKS} select doc_id, block_id, {D.preview('content', 120)} as preview, {D.stable_token('content')} as token, left({D.collapsed('content')}, 500) as excerpt from blocks")
def f27(spark, sf_dir):
    return blocks(spark, sf_dir).selectExpr("doc_id", "block_id", f"{X.preview('content', 120)} as preview", f"{X.stable_token('content')} as token", f"left({X.collapsed('content')}, 500) as excerpt")


@query("f36_translation_plan", f"with {BLOCKS} select doc_id, block_id, {D.passthrough('content')} as passthrough, least(2048, greatest(192, floor(length(content) * 1.8::double)::int + 96))::int as budget from blocks")
def f36(spark, sf_dir):
    return blocks(spark, sf_dir).selectExpr("doc_id", "block_id", f"{X.is_passthrough('content')} as passthrough", f"{X.translation_budget('content')} as budget")


@query("p01_index_text", f"with {BLOCKS} select doc_id, block_id, case when n % 9 = 4 then '' when block_type = 'formula' then {D.wrapped_math('content')} else content end as index_text from blocks")
def p01(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("shadowed_by", F.expr("case when n % 9 = 4 then 'other' end"))
    return b.selectExpr("doc_id", "block_id", f"{X.index_text('block_type', 'content', 'shadowed_by')} as index_text")


@query(
    "p03_block_metadata",
    f"""with {BLOCKS}, s as (select *, last_value(case when block_type = 'heading' then content end ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row) as section from blocks)
    select doc_id, block_id, page_num, block_type, coalesce(section, '') as section, printf('%.2f,%.2f,%.2f,%.2f', x0, y0, x1, y1) as bbox, array_to_string(regexp_extract_all(lower(content), '[a-z]+')[1:3], ', ') as keywords from s""",
)
def p03(spark, sf_dir):
    """Flat metadata, with the nearest heading carried as the section."""
    b = blocks(spark, sf_dir).withColumn("section", F.expr("last(case when block_type = 'heading' then content end, true) over (partition by doc_id order by n rows unbounded preceding)"))
    return b.selectExpr("doc_id", "block_id", "page_num", "block_type", "coalesce(section, '') as section", "format_string('%.2f,%.2f,%.2f,%.2f', x0, y0, x1, y1) as bbox", "concat_ws(', ', slice(regexp_extract_all(lower(content), '[a-z]+', 0), 1, 3)) as keywords")


@query("p05_graph_candidates", f"with {BLOCKS} select doc_id, count(*) as n, min(block_id) as first_id from blocks where n % 9 <> 4 and block_type in ('heading', 'paragraph', 'formula', 'table') and trim(content) <> '' group by doc_id")
def p05(spark, sf_dir):
    return blocks(spark, sf_dir).where("n % 9 <> 4 and block_type in ('heading', 'paragraph', 'formula', 'table') and trim(content) <> ''").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("block_id").alias("first_id"))


_WORDS = r"[A-Za-z]{3,}"


@query(
    "p13_should_ocr",
    f"with {FORMULAS}, t as (select result_id, trim(latex) as t from formulas) select result_id from t where length(t) between 8 and 260 and not (length(t) > 170 and regexp_matches(t, '[.!?]')) and len(regexp_extract_all(t, '{_WORDS}')) <= 8 and contains(t, '=') and not contains(t, '\\') and {D.count_of('t', '=+-*/^_()[]{}∈≤≥×·√∑∫')} >= 2",
)
def p13(spark, sf_dir):
    """Formula blocks that read like flattened mathematics and should be recognised from the page image."""
    t = formulas(spark, sf_dir).withColumn("t", F.expr("trim(latex)"))
    rule = f"length(t) between 8 and 260 and not (length(t) > 170 and t rlike '[.!?]') and regexp_count(t, '{_WORDS}') <= 8 and contains(t, '=') and not contains(t, {X.literal(chr(92))}) and {X.count_of('t', '=+-*/^_()[]{}∈≤≥×·√∑∫')} >= 2"
    return t.where(rule).select("result_id")


#: What tells prose from formulas, and commands of LaTeX.
_PROSE = r"(?i)^\s*(?:proof|we\s+have|if|for|the|where|therefore|thus|hence|this|let)\b"
_FIGURE = r"(?i)\b(?:called|figure|points?|neighborhood|unit\s+circle)\b"
_COMMON = r"(?i)\b(?:the|and|or|if|only|with|for|any|maps?|continuous|metric|proof|called|figure|set|points?|neighborhood)\b"
_COMMANDS = r"\\(?:frac|sum|int|prod|lim|partial|sqrt|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|phi|omega|infty|nabla|mathbf|mathcal|mathbb|mathfrak|text|begin|end|left|right|langle|rangle|times|cdot|pm|leq|geq|neq|approx|equiv|sim|rightarrow|leftarrow|Rightarrow|Leftarrow|longrightarrow)"


def _formula_rule(dialect: str, font: str) -> str:
    """The cascade that tells a formula line from prose, for either dialect; ``font``: its fonts' names in one text."""
    spans = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in X.MATH_RANGES)
    if dialect == "spark":
        match, count, has, flat, chars = (lambda x, p: f"({x} rlike {X.literal(p)})"), (lambda x, p: f"regexp_count({x}, {X.literal(p)})"), (lambda x, c: f"contains({x}, '{c}')"), X.collapsed("t"), X.count_of("t", X.MATH_MARKERS)
    else:
        match, count, has, flat, chars = (lambda x, p: f"regexp_matches({x}, {D.q(p)})"), (lambda x, p: f"len(regexp_extract_all({x}, {D.q(p)}))"), (lambda x, c: f"contains({x}, '{c}')"), D.collapsed("t"), D.count_of("t", X.MATH_MARKERS)
    symbols = count("t", f"[{spans}]")
    math_font = match(f"lower({font})", "|".join(X.MATH_FONTS))
    return f"""case when length(t) < 8 then false
      when {has('t', '@')} and length(t) < 60 then false
      when length({flat}) > 180 and {has(flat, '.')} then false
      when {match(flat, _PROSE)} and english >= 4 then false
      when {match(flat, _FIGURE)} then false
      when english >= 6 and {match(flat, _COMMON)} then false
      when english > 14 and {chars} < 8 then false
      when english > 24 then false
      when {math_font} and length(t) > 10 and ({chars} >= 2 or english <= 8) then true
      when {count('t', _COMMANDS)} >= 2 then true
      else {symbols} > 0.15 * length(t) and length(t) < 300 end"""


_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_FONTS = "['Helvetica', 'CMR10', 'Times', 'STIXGeneral', 'TeXGyreTermes', 'Cambria']"
#: Words of three letters or more, with punctuation round them at most: one pass instead of a split with a test for each word.
_WORD = r"(?<!\S)[!-/:-@\[-`{-~]*\p{L}{3,}[!-/:-@\[-`{-~]*(?!\S)"


@query(
    "p08_is_formula",
    rf"""with {BLOCKS}, {FORMULAS}, t as (select 'b' || doc_id || block_id as id, content || case when n % 11 = 0 then ' 𝒜𝓑𝟙𝛼' else '' end as t, {_FONTS}[(n % 6 + 1)::int] as font from blocks union all select 'f' || result_id, latex, '' from formulas),
    e as (select *, len(list_filter(string_split_regex(t, '\s+'), lambda w: length(trim(w, '{_PUNCT}')) > 2 and regexp_full_match(trim(w, '{_PUNCT}'), '\p{{L}}+')))::int as english from t)
    select id, english, {_formula_rule('duck', 'font')} as is_formula from e""",
)
def p08(spark, sf_dir):
    """Formula lines by their text and fonts; every eleventh block has letters of the mathematical alphabets put to it."""
    b = blocks(spark, sf_dir).selectExpr("concat('b', doc_id, block_id) as id", "concat(content, if(n % 11 = 0, ' 𝒜𝓑𝟙𝛼', '')) as t", f"element_at(array{_FONTS.replace('[', '(').replace(']', ')')}, cast(n % 6 + 1 as int)) as font")
    t = b.unionAll(formulas(spark, sf_dir).selectExpr("concat('f', result_id) as id", "latex as t", "'' as font"))
    e = t.withColumn("english", F.expr(f"regexp_count(t, {X.literal(_WORD)})"))
    return e.selectExpr("id", "english", f"{_formula_rule('spark', 'font')} as is_formula")


@query(
    "f25_toc",
    rf"""with {BLOCKS}, h as (select doc_id, page_num, n, trim(trim({D.collapsed('content')}, ' -:–—：|•·')) as title from blocks where block_type = 'heading'),
    ok as (select * from h where title <> '' and length(title) <= 160 and not regexp_matches(title, '[\p{{Cc}}\p{{Cs}}\p{{Co}}]') and not regexp_matches(title, '{"|".join(X.MOJIBAKE)}') and len(regexp_extract_all(title, '[\p{{L}}\p{{N}}]')) >= 2 and len(regexp_extract_all(title, '[\p{{L}}\p{{N}}]')) >= 0.35 * length({D.sub('title', r'\s')})
           and not (not regexp_matches(title, '[\x{{4e00}}-\x{{9fff}}]') and len(regexp_extract_all(title, '[A-Za-z]+|\d+')) > 0 and len(list_filter(regexp_extract_all(title, '[A-Za-z]+|\d+'), lambda t: length(t) = 1 or regexp_full_match(lower(t), '\d+|{"|".join(X.FRAGMENTS)}'))) >= 0.75 * len(regexp_extract_all(title, '[A-Za-z]+|\d+')))),
    one as (select *, row_number() over (partition by doc_id, lower(title) order by n) as k from ok), kept as (select * from one where k = 1)
    select doc_id, page_num, title, row_number() over (partition by doc_id order by n)::int as place from kept qualify count(*) over (partition by doc_id) >= 2""",
)
def f25(spark, sf_dir):
    """Tables of contents from heading blocks: readable titles, each once, two at least."""
    title = f"trim(trim(both ' -:–—：|•·' from {X.collapsed('content')}))"
    h = blocks(spark, sf_dir).where("block_type = 'heading'").withColumn("title", F.expr(title))
    readable = "regexp_count(title, '[\\\\p{L}\\\\p{N}]')"
    words = "regexp_extract_all(title, '[A-Za-z]+|[0-9]+', 0)"
    ok = h.where(f"title <> '' and length(title) <= 160 and not title rlike '[\\\\p{{Cc}}\\\\p{{Cs}}\\\\p{{Co}}\\\\p{{Cn}}]' and not title rlike '{"|".join(X.MOJIBAKE)}' and {readable} >= 2 and {readable} >= 0.35 * length({X.regex_replace('title', r'\s')})")
    ok = ok.where(f"not (not title rlike '[\\\\u4e00-\\\\u9fff]' and size({words}) > 0 and size(filter({words}, t -> length(t) = 1 or lower(t) rlike '^([0-9]+|{"|".join(X.FRAGMENTS)})$')) >= 0.75 * size({words}))")
    one = ok.withColumn("k", F.expr("row_number() over (partition by doc_id, lower(title) order by n)")).where("k = 1")
    out = one.withColumn("all", F.expr("count(*) over (partition by doc_id)")).where("all >= 2")
    return out.selectExpr("doc_id", "page_num", "title", "row_number() over (partition by doc_id order by n) as place")


@query("f42_span_context", rf"with m as (select doc_id, text, strpos(text, 'the') as p from documents where contains(text, 'the')) select doc_id, p::int as p, {D.collapsed('substr(text, greatest(p - 180, 1), (p - greatest(p - 180, 1))::bigint)')} as before, {D.collapsed('substr(text, p + 3, 180)')} as after from m")
def f42(spark, sf_dir):
    m = table(spark, sf_dir, "documents").where("contains(text, 'the')").selectExpr("doc_id", "text", "locate('the', text) as p")
    return m.selectExpr("doc_id", "p", f"{X.collapsed('substring(text, greatest(p - 180, 1), p - greatest(p - 180, 1))')} as before", f"{X.collapsed('substring(text, p + 3, 180)')} as after")
