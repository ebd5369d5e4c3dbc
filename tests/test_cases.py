"""Candidates matched to sources by cases and groups, against comparing each with each."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from foliogrid.functions import text as X
from foliogrid.plans import cases
from foliogrid.plans.fusion import formula_similarity


def test_scoped_matches_as_each_with_each(spark):
    rng = random.Random(3)
    normals = ["ab+1", "ab+22", "cd=1", "x^{2}", "ab12cd", "q", "w=", "ab+1x", "zz zz"]
    page = lambda: rng.choice([None, 0, 3, 5, 9, 12, 40, 900])
    candidates = [(i, rng.choice([*normals, "é"]), page()) for i in range(60)]
    sources = [(i, rng.choice(normals[:-2]), first, None if rng.random() < 0.3 else (first or 0) + rng.randrange(5)) for i in range(80) for first in [rng.choice([None, 0, 4, 10, 11, 30])]]
    said = spark.createDataFrame([(x,) for x in {c[1] for c in candidates} | {s[1] for s in sources}], "normal string")
    tokens = {r.normal: set(r.t) for r in said.select("normal", F.expr(X.match_tokens("normal", parts=True)).alias("t")).collect()}
    names = ("same_page_window", "near_page_window", "outside_page_window", "no_source_page_hint")

    def level(at, first, last):
        if first is not None and at is not None:
            for k, more in ((0, 0), (1, 2)):
                if at >= first - more and (last is None or at <= last + more):
                    return k
        return 2 if first is not None else 3

    for limit in (4, 30):
        want = set()
        for i, normal, at in candidates:
            met = [s for s in sources if tokens[normal] & tokens[s[1]]]
            met = met or [s for s in sources if s[2] is not None and at is not None and s[2] - 2 <= at <= (s[2] if s[3] is None else s[3]) + 2] or sources[:limit]
            met = sorted(met, key=lambda s: (min(level(at, *s[2:]), 2), -len(tokens[normal] & tokens[s[1]]), abs(len(s[1]) - len(normal)), s[0]))[:limit]
            best = max(((float(Decimal(repr(formula_similarity(normal, s[1]))).quantize(Decimal("0.001"), ROUND_HALF_UP)), -k, s) for k, s in enumerate(met)), key=lambda x: x[:2])
            want.add((i, best[2][0], best[0], -best[1], names[level(at, *best[2][2:])]) if best[0] > 0 else (i, None, 0.0, -1, ""))
        got = cases.scoped_matches(spark.createDataFrame(candidates, "id long, normal string, page long"), spark.createDataFrame(sources, "source_id long, normal string, first_page long, last_page long"), limit)
        assert {tuple(r) for r in got.collect()} == want
    none = cases.scoped_matches(spark.createDataFrame(candidates, "id long, normal string, page long"), spark.createDataFrame([], "source_id long, normal string, first_page long, last_page long"))
    assert {tuple(r)[1:] for r in none.collect()} == {(None, 0.0, -1, "")} and none.count() == 60


def test_many_equal_sources_are_one_group(spark):
    made = []
    kept = cases.mapped_pages
    cases.mapped_pages = lambda sides, *rest: made.append(sides[0].count()) or kept(sides, *rest)
    try:
        candidates = spark.range(200).selectExpr("id", "'ab+1' as normal", "id % 50 + 1000 as page")
        sources = spark.range(2000).selectExpr("id as source_id", "'ab+2' as normal", "10L as first_page", "20L as last_page")
        assert cases.scoped_matches(candidates, sources).select("source_id", "rank").distinct().collect() == [(0, 0)]
    finally:
        cases.mapped_pages = kept
    assert made == [1]


def test_joins_of_many_groups_say_the_same(spark, monkeypatch):
    rng = random.Random(5)
    normals = ["ab+1", "ab+22", "cd=1", "x^{2}", "ab12cd", "q", "w=", "ab+1x", "zz zz", "ab+3", "ab+4"]
    candidates = spark.createDataFrame([(i, rng.choice([*normals, "é", "ab+9"]), rng.choice([None, 0, 3, 9, 12, 900])) for i in range(80)], "id long, normal string, page long")
    sources = [(i, rng.choice([*normals, None]), rng.choice([None, 0, 4, 10, 30]), rng.choice([None, 32, 40])) for i in range(300)]
    sources = spark.createDataFrame(sources, "source_id long, normal string, first_page long, last_page long")
    want = {limit: {tuple(r) for r in cases.scoped_matches(candidates, sources, limit).collect()} for limit in (3, 80)}
    monkeypatch.setattr(cases, "HELD_IDS", 0)
    for limit in want:
        assert {tuple(r) for r in cases.scoped_matches(candidates, sources, limit).collect()} == want[limit]


def test_cases_do_not_grow_with_the_groups_that_they_meet(spark, monkeypatch):
    made = []
    kept = cases.mapped_pages
    monkeypatch.setattr(cases, "mapped_pages", lambda sides, *rest: made.append(sides[0].count()) or kept(sides, *rest))
    candidates = spark.range(50).selectExpr("id", "concat('ab+', id) as normal", "id as page")
    sources = spark.range(3000).selectExpr("id as source_id", "concat('ab+', id % 60) as normal", "10L as first_page", "20L as last_page")
    got = cases.scoped_matches(candidates, sources)
    assert got.where("similarity = 1 and source_id = id").count() == 50 and made == [50]
