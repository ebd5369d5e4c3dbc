"""Partners scoped by page against comparing each row with each."""

import random
from collections import Counter

from pyspark.sql import functions as F

from foliogrid.functions import text as X
from foliogrid.plans import segmentation


def test_scoped_blocking_as_each_with_each(spark):
    rng = random.Random(7)
    normals = ["ab+1", "ab+22", "cd=1", "x^{2}", "ab12cd", "q", "ab+1x", "zz zz"]
    left = [(i, rng.choice([*normals, None]), rng.randrange(12)) for i in range(60)]
    right = [(100 + i, rng.choice(normals), first, first + rng.randrange(3)) for i in range(90) for first in [rng.randrange(12)]]
    right += right[:8] + right[:3]  # rows that come again share their tokens again
    said = spark.createDataFrame([(x,) for x in normals], "normal string")
    tokens = {r.normal: set(r.t) for r in said.select("normal", F.expr(X.match_tokens("normal")).alias("t")).collect()}
    for limit in (2, 5, 200):
        want = set()
        for i, normal, page in left:
            met = []
            for (j, other, first, last), copies in Counter(right).items():
                if normal and (shared := len(tokens[normal] & tokens[other])):
                    tier = 0 if first <= page <= last else 1 if first - 2 <= page <= last + 2 else 2
                    met.append((tier, -shared * copies, abs(len(other) - len(normal)), j))
            want |= {(i, x[3], x[0], k) for k, x in enumerate(sorted(met)[:limit], 1)}
        got = segmentation.scoped_blocking(spark.createDataFrame(left, "id long, normal string, page int"), spark.createDataFrame(right, "id long, normal string, first_page int, last_page int"), limit)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_equal_formulas_meet_once(spark, monkeypatch):
    """2,000 rows on each side, of one form: no join makes their product."""
    made = []
    kept = segmentation.cut
    monkeypatch.setattr(segmentation, "cut", lambda df: made.append((out := kept(df)).count()) or out)
    left = spark.range(2000).selectExpr("id", "'ab+1' as normal", "cast(id % 3 as int) as page")
    right = spark.range(2000).selectExpr("id + 5000 as id", "'ab+2' as normal", "cast(id % 4 as int) as first_page", "cast(id % 4 as int) as last_page")
    got = segmentation.scoped_blocking(left, right)
    assert got.count() == 10_000
    assert {(r.right_id, r.tier) for r in got.where("left_id = 0").collect()} == {(5000 + 4 * i, 0) for i in range(5)}
    assert made[-1] <= 5 * 3 * 3  # by page and tier, the first five
