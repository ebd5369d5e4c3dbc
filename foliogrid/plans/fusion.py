"""Candidate fusion: ranking, agreement, coverage, gates and priorities; fuzzy matching behind token blocking."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.functions import text as X
from foliogrid.plans import duck as D
from foliogrid.plans.base import FORMULAS, formulas, query
from foliogrid.session import cut

#: Stages that full coverage has, and marks of warnings that stop an acceptance.
EXPECTED = ("parsed_blocks", "pdf_structure", "local_precise", "cloud_semantic")
RISKS = "failed|empty|low_confidence|prose_like|table"
BLOCK_LIMIT = 60
_QUOTED = ", ".join(f"'{s}'" for s in EXPECTED)

def ranked_sql(source: str, name: str) -> str:
    return f"{name} as (select *, row_number() over (partition by candidate_id order by similarity desc, (stage <> 'parsed_blocks')::int desc, score desc, result_id) as place from {source})"


_RANKED = f"{FORMULAS}, {ranked_sql('formulas', 'ranked')}"


def ranked(f: DataFrame) -> DataFrame:
    return f.withColumn("place", F.expr("row_number() over (partition by candidate_id order by similarity desc, cast(stage <> 'parsed_blocks' as int) desc, score desc, result_id)"))


@query("w06_fusion_ranking", f"with {_RANKED} select candidate_id, result_id, place::int as place from ranked")
def w06(spark, sf_dir):
    return ranked(formulas(spark, sf_dir)).select("candidate_id", "result_id", "place")


@query("a16_stage_quality", f"with {FORMULAS} select candidate_id, stage, round_even(max(similarity), 3) as best_similarity, first(result_id order by similarity desc, result_id) as best_result_id, count(*) as n from formulas group by all")
def a16(spark, sf_dir):
    return formulas(spark, sf_dir).groupBy("candidate_id", "stage").agg(F.expr("bround(max(similarity), 3)").alias("best_similarity"), F.expr("max_by(result_id, struct(similarity, -result_id))").alias("best_result_id"), F.count("*").alias("n"))


def fusion_rows(f: DataFrame) -> DataFrame:
    """One row for each group: best candidate, stages, coverage, risks, gate and decision."""
    best = "min_by(struct(result_id, latex, similarity), place)"
    g = ranked(f).groupBy("candidate_id").agg(
        F.expr(best).alias("best"),
        F.count("*").alias("candidate_count"),
        F.expr("array_sort(collect_set(stage))").alias("stages"),
        F.expr(f"array_sort(collect_set(if(lower(warning) rlike '{RISKS}', warning, null)))").alias("risk_flags"),
        F.expr("max(if(stage = 'local_precise', similarity, null))").alias("precise"),
        F.expr("max(if(stage in ('pdf_structure', 'parsed_blocks', 'inline_spans'), similarity, null))").alias("born"),
    )
    g = g.withColumn("coverage", F.expr(f"bround(size(array_intersect(stages, array({_QUOTED}))) / 4.0D, 3)"))
    reasons = """array_compact(array(if(best.similarity < 0.9D, 'similarity', null), if(precise is null, 'no_precise', null),
        if(size(risk_flags) > 0, 'risk', null), if(precise + 0.02D < born, 'degraded', null)))"""
    g = g.withColumn("reasons", F.expr(reasons))
    return g.withColumn("decision", F.expr("if(size(reasons) = 0, 'ready_for_manual_accept', 'needs_more_evidence')"))


def fusion_sql(source: str, g: str = "g", name: str = "ranked") -> str:
    """CTEs of fused groups, ``g``, from candidates."""
    return f"""{ranked_sql(source, name)}, {g}0 as (select candidate_id, count(*) as candidate_count, arg_min(result_id, place) as best_id, arg_min(latex, place) as best_latex, arg_min(similarity, place) as best_similarity,
  list_sort(list(distinct stage)) as stages, coalesce(list_sort(list(distinct warning) filter (where regexp_matches(lower(warning), '{RISKS}'))), []) as risk_flags,
  max(similarity) filter (where stage = 'local_precise') as precise, max(similarity) filter (where stage in ('pdf_structure', 'parsed_blocks', 'inline_spans')) as born from {name} group by candidate_id),
{g}1 as (select *, round_even(len(list_intersect(stages, [{_QUOTED}])) / 4.0::double, 3) as coverage,
  list_filter([case when best_similarity < 0.9::double then 'similarity' end, case when precise is null then 'no_precise' end, case when len(risk_flags) > 0 then 'risk' end, case when precise + 0.02::double < born then 'degraded' end], lambda r: r is not null) as reasons from {g}0),
{g} as (select *, case when len(reasons) = 0 then 'ready_for_manual_accept' else 'needs_more_evidence' end as decision from {g}1)"""


_FUSION = f"{FORMULAS}, {fusion_sql('formulas')}"


@query("a18_fusion_rows", f"with {_FUSION} select candidate_id, candidate_count, best_id as best_result, array_to_string(stages, ',') as stages, array_to_string(risk_flags, ',') as risks, coverage, array_to_string(reasons, ',') as reasons, decision from g")
def a18(spark, sf_dir):
    """Groups with stages, coverage (A18), risks (P18) and gate."""
    return fusion_rows(formulas(spark, sf_dir)).selectExpr("candidate_id", "candidate_count", "best.result_id as best_result", "array_join(stages, ',') as stages", "array_join(risk_flags, ',') as risks", "coverage", "array_join(reasons, ',') as reasons", "decision")


@query("a04_decision_counts", f"with {_FUSION} select decision, count(*) as n from g group by decision")
def a04(spark, sf_dir):
    return fusion_rows(formulas(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    "w16_review_priority",
    f"""with {_FUSION}, c as (select *, {D.complexity('best_latex')} as complexity, {D.formula_normal('best_latex')} as normal from g),
    p as (select *, 500.0::double - case when stages = ['inline_spans'] then 120 else 0 end + case when list_contains(stages, 'parsed_blocks') or list_contains(stages, 'pdf_structure') then 180 else 0 end
      + case when list_contains(stages, 'local_precise') then 90 else 0 end + case when candidate_count > 1 then least((candidate_count - 1) * 30.0::double, 120.0::double) else 0 end
      + greatest(0.0::double, 1.0::double - best_similarity) * 220 + coverage * 80 + case when decision = 'ready_for_manual_accept' then 80 else 0 end + least(len(risk_flags) * 45.0::double, 180.0::double)
      + complexity * 16 - case when stages = ['inline_spans'] and candidate_count = 1 and len(risk_flags) = 0 and (length(normal) <= 1 or (length(normal) <= 2 and regexp_full_match(normal, '[a-z]+'))) then 180 else 0 end as raw from c)
    select candidate_id, round(greatest(raw, 1.0::double), 3) as priority from p""",
)
def w16(spark, sf_dir):
    """How much a semantic review of a group is worth."""
    g = fusion_rows(formulas(spark, sf_dir)).withColumn("normal", F.expr(X.formula_normal("best.latex")))
    only_inline = "stages = array('inline_spans')"
    low = f"{only_inline} and candidate_count = 1 and size(risk_flags) = 0 and (length(normal) <= 1 or (length(normal) <= 2 and normal rlike '^[a-z]+$'))"
    raw = f"""500.0D - if({only_inline}, 120, 0) + if(arrays_overlap(stages, array('parsed_blocks', 'pdf_structure')), 180, 0) + if(array_contains(stages, 'local_precise'), 90, 0)
      + if(candidate_count > 1, least((candidate_count - 1) * 30.0D, 120.0D), 0) + greatest(0.0D, 1.0D - best.similarity) * 220 + coverage * 80 + if(decision = 'ready_for_manual_accept', 80, 0)
      + least(size(risk_flags) * 45.0D, 180.0D) + {X.review_complexity('best.latex')} * 16 - if({low}, 180, 0)"""
    return g.select("candidate_id", F.round(F.greatest(F.expr(raw), F.lit(1.0)), 3).alias("priority"))


@query("a19_accuracy", f"with {FORMULAS} select stage, count(*) as n, count(*) filter (where similarity >= 0.98) as exact, count(*) filter (where similarity >= 0.80) as near, count(*) filter (where similarity >= 0.55) as weak, round(avg(similarity), 6) as mean from formulas where length({D.formula_normal('latex')}) >= 4 group by stage")
def a19(spark, sf_dir):
    """How many candidates of a stage match exactly, nearly and weakly; too short ones don't count."""
    f = formulas(spark, sf_dir).where(f"length({X.formula_normal('latex')}) >= 4")
    return f.groupBy("stage").agg(F.count("*").alias("n"), F.expr("count_if(similarity >= 0.98)").alias("exact"), F.expr("count_if(similarity >= 0.80)").alias("near"), F.expr("count_if(similarity >= 0.55)").alias("weak"), F.round(F.avg("similarity"), 6).alias("mean"))


@query(
    "a20_monotonic_check",
    f"""with {FORMULAS}, m as (select stage, round(avg(similarity), 6) as mean, count(*) as n, list_position(['parsed_blocks', 'pdf_structure', 'local_precise', 'cloud_semantic'], stage) as place from formulas where stage <> 'inline_spans' group by stage),
    d as (select stage, lag(stage) over (order by place) as before, round(mean - lag(mean) over (order by place), 3) as delta, n >= lag(n) over (order by place) as coverage_comparable from m) select *, delta >= 0 as accuracy_passed from d where before is not null""",
)
def a20(spark, sf_dir):
    """Whether accuracy holds from each stage to the next; one row for a stage, so the window is four rows."""
    place = f"array_position(array({_QUOTED}), stage)"
    m = formulas(spark, sf_dir).where("stage <> 'inline_spans'").groupBy("stage").agg(F.round(F.avg("similarity"), 6).alias("mean"), F.count("*").alias("n")).withColumn("place", F.expr(place))
    w = "over (order by place)"
    d = m.selectExpr("stage", f"lag(stage) {w} as before", f"round(mean - lag(mean) {w}, 3) as delta", f"n >= lag(n) {w} as coverage_comparable")
    return d.where("before is not null").selectExpr("*", "delta >= 0 as accuracy_passed")


@query("p17_targeted_review", f"with {_FUSION} select candidate_id from g where decision = 'needs_more_evidence' and not list_contains(stages, 'local_precise') and stages <> ['inline_spans']")
def p17(spark, sf_dir):
    return fusion_rows(formulas(spark, sf_dir)).where("decision = 'needs_more_evidence' and not array_contains(stages, 'local_precise') and size(array_except(stages, array('inline_spans'))) > 0").select("candidate_id")


_WARNED = f"['', 'Low_Confidence', 'tabular_alignment', 'empty_latex', 'minor', {', '.join(f"'{w}'" for w in X.IMPRECISE)}]"


@query("p14_needs_precision", f"with {FORMULAS}, w as (select result_id, case when result_id % 23 = 0 then null else score end as score, [warning, {_WARNED}[(result_id % {5 + len(X.IMPRECISE)} + 1)::int]] as warnings from formulas) select result_id from w where list_has_any(list_transform(warnings, lambda w: lower(w)), [{', '.join(f"'{w}'" for w in X.IMPRECISE)}]) or coalesce(score, 1.0) < {X.LEAST_SCORE}")
def p14(spark, sf_dir):
    """Results whose warnings or score ask for the precise round."""
    w = formulas(spark, sf_dir).selectExpr("result_id", "if(result_id % 23 = 0, null, score) as score", f"array(warning, element_at(array{_WARNED.replace('[', '(').replace(']', ')')}, cast(result_id % {5 + len(X.IMPRECISE)} + 1 as int))) as warnings")
    return w.where(X.needs_precision("warnings", "score")).select("result_id")


@query("a30_command_counts", rf"with {FORMULAS}, c as (select unnest(regexp_extract_all(latex, '\\[A-Za-z]+')) as command from formulas) select case when command in ('\text', '\operatorname') then '\mathrm' else command end as command, count(*) as n from c group by 1")
def a30(spark, sf_dir):
    c = formulas(spark, sf_dir).selectExpr(f"explode(regexp_extract_all(latex, {X.literal(r'\\[A-Za-z]+')}, 0)) as command")
    same = X.literal("\\mathrm")
    return c.selectExpr(f"if(command in ({X.literal(chr(92) + 'text')}, {X.literal(chr(92) + 'operatorname')}), {same}, command) as command").groupBy("command").agg(F.count("*").alias("n"))


def blocked_normals(left: DataFrame, right: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(left_normal, right_id, right_normal, shared, place): the ``limit`` likeliest partners of each different normal form by shared tokens, then by length.

    Both have (id, normal). Equal formulas have equal partners, so different forms meet on their tokens, as numbers; of a form's ids the first ``limit`` can count.
    """
    forms = lambda df, k: cut(df.select("normal").distinct().withColumn(k, F.monotonically_increasing_id()))
    ln, rn = forms(left, "l"), forms(right, "r")
    tokens = lambda df, k: df.selectExpr(k, f"length(normal) as {k}n", f"explode({X.match_tokens('normal')}) as token")
    pairs = tokens(ln, "l").join(tokens(rn, "r"), "token").groupBy("l", "r", "ln", "rn").agg(F.count("*").alias("shared"))
    # a form counts if fewer than `limit` are better
    near = pairs.withColumn("better", F.expr("rank() over (partition by l order by shared desc, abs(rn - ln))")).where(F.col("better") <= limit)
    ids = right.join(rn, "normal").selectExpr("r", "id as right_id", "normal as right_normal").withColumn("k", F.expr("row_number() over (partition by r order by right_id)")).where(F.col("k") <= limit).drop("k")
    place = "row_number() over (partition by l order by shared desc, abs(rn - ln), right_id)"
    best = near.join(ids, "r").withColumn("place", F.expr(place)).where(F.col("place") <= limit)
    return best.join(ln, "l").select(F.col("normal").alias("left_normal"), "right_id", "right_normal", "shared", "place")


def blocked(left: DataFrame, right: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(left_id, right_id, left_normal, right_normal, shared, place): the partners of each formula; nothing is compared that shares no token."""
    return left.selectExpr("id as left_id", "normal as left_normal").join(blocked_normals(left, right, limit), "left_normal").select("left_id", "right_id", "left_normal", "right_normal", "shared", "place")


def first_rows(left: DataFrame, right: DataFrame, met: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """As ``blocked_normals``, the first ``limit`` of ``right`` by id for each form of ``left`` that isn't in ``met``; a null partner if there are none."""
    alone = left.selectExpr("normal as left_normal").distinct().join(met.select("left_normal").distinct(), "left_normal", "left_anti")
    first = right.select("id", "normal").orderBy("id").limit(limit).collect()
    kind = right.schema["id"].dataType
    listed = [F.struct(F.lit(r[0]).cast(kind).alias("right_id"), F.lit(r[1]).alias("right_normal"), F.lit(i).alias("place")) for i, r in enumerate(first, 1)]
    none = F.array().cast(f"array<struct<right_id:{kind.simpleString()},right_normal:string,place:int>>")
    return alone.withColumn("r", F.explode_outer(F.array(*listed) if listed else none)).select("left_normal", "r.right_id", "r.right_normal", F.lit(0).cast("long").alias("shared"), "r.place")


def formula_similarity(left: str, right: str) -> float:
    """Matching blocks' share of both; a formula that holds the other has their ratio of lengths at least."""
    score = difflib.SequenceMatcher(None, left, right).ratio()
    if left and right and (left in right or right in left):
        score = max(score, min(len(left), len(right)) / max(len(left), len(right)))
    return score


def similarity(left: str, right: str) -> Column:
    """``formula_similarity`` of two columns, by batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {k: formula_similarity(*k) for k in set(zip(a, b, strict=True))}
        return pd.Series([known[k] for k in zip(a, b, strict=True)])

    return run(left, right)


_TWO = f"""{FORMULAS}, n as (select result_id as id, {D.formula_normal('latex')} as normal, stage from formulas), tok as (select id, normal, stage, unnest({D.match_tokens('normal')}) as token from n),
pairs as (select l.id as left_id, r.id as right_id, l.normal as ln, r.normal as rn, count(*) as shared from tok l join tok r using (token) where l.stage = 'parsed_blocks' and r.stage = 'pdf_structure' group by all),
pl as (select *, row_number() over (partition by left_id order by shared desc, abs(length(rn) - length(ln)), right_id) as place from pairs)"""


@query("j21_blocking", f"with {_TWO} select left_id, right_id, shared, place::int as place from pl where place <= 5")
def j21(spark, sf_dir):
    """The five likeliest partners of each parsed formula among the structural ones, by shared tokens."""
    n = formulas(spark, sf_dir).selectExpr("result_id as id", f"{X.formula_normal('latex')} as normal", "stage")
    return blocked(n.where("stage = 'parsed_blocks'"), n.where("stage = 'pdf_structure'"), 5).select("left_id", "right_id", "shared", "place")


@query("f17_best_matches")
def f17(spark, sf_dir):
    """The best structural match of each parsed formula by similarity, among ``BLOCK_LIMIT`` blocked partners or, without any, the first rows."""
    n = formulas(spark, sf_dir).selectExpr("result_id as id", f"{X.formula_normal('latex')} as normal", "stage").where("length(normal) >= 4")
    return best_matches(n.where("stage = 'parsed_blocks'"), n.where("stage = 'pdf_structure'"))


def best_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, similarity), a row for each of ``left``; no partner where nothing is similar. Different forms are compared once."""
    met = cut(blocked_normals(left, right))
    pairs = met.unionByName(first_rows(left, right, met))
    scored = pairs.withColumn("similarity", F.round(similarity("left_normal", F.coalesce("right_normal", F.lit(""))), 3))
    best = scored.groupBy("left_normal").agg(F.expr("max_by(if(similarity > 0, right_id, null), struct(similarity, -place))").alias("right_id"), F.max("similarity").alias("similarity"))
    return left.selectExpr("id as left_id", "normal as left_normal").join(best, "left_normal").select("left_id", "right_id", "similarity")


@query("a17_agreement")
def a17(spark, sf_dir):
    """Mean similarity of a group's different formulas: 1 for one, else over all pairs of the candidates."""
    f = formulas(spark, sf_dir).selectExpr("candidate_id", f"{X.collapsed('latex')} as latex", f"{X.formula_normal('latex')} as normal").where("latex <> ''").distinct()
    a, b = f.selectExpr("candidate_id", "latex as l1", "normal as n1"), f.selectExpr("candidate_id", "latex as l2", "normal as n2")
    scores = a.join(b, "candidate_id").where("l1 < l2 and n1 <> '' and n2 <> ''").withColumn("s", similarity("n1", "n2"))
    mean = scores.groupBy("candidate_id").agg(F.avg("s").alias("mean"))
    sizes = f.groupBy("candidate_id").agg(F.count("*").alias("n"))
    return sizes.join(mean, "candidate_id", "left").selectExpr("candidate_id", "n", "case when n = 1 then 1.0D else coalesce(bround(mean, 3), 0.0D) end as agreement")
