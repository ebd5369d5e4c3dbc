"""Bounded pairs against all pairs."""

import numpy as np
import pytest

from foliogrid.functions import geometry as G
from foliogrid.operators import pairs as P


def page(n, seed=0, wide=4000.0):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, wide, n).round(2), rng.uniform(0, 300, n).round(2)
    return [(1, f"g{i:05d}", "glyph", float(x[i]), float(y[i]), float(x[i] + 5), float(y[i] + 8)) for i in range(n)]


SCHEMA = "page_num int, node_id string, node_type string, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("n", [1, 20, 300])
def test_nearest_equal_brute_force(spark, n):
    rows = sorted(page(n, n), key=lambda r: (r[3], r[4], r[1]))
    x, y = np.array([(r[3] + r[5]) / 2 for r in rows]), np.array([(r[4] + r[6]) / 2 for r in rows])
    want = {}
    for i, r in enumerate(rows):
        score = [(round(float(np.hypot(x[j] - x[i], y[j] - y[i]) + abs(j - i) * 0.25), 9), rows[j][1]) for j in range(n) if j != i]
        want[r[1]] = [t for _, t in sorted(score)[: P.NEIGHBOURS]]
    df = spark.createDataFrame([*rows, (1, "v1", "vector", 0.0, 0.0, 9.0, 1.0)][: n + (n == 1)], SCHEMA).where("node_type = 'glyph'")
    for most in (P.ALL, 0):
        got = {}
        for r in P.nearest_pairs(df, most=most).orderBy("source", "place").collect():
            got.setdefault(r.source, []).append(r.target)
        assert got == {k: v for k, v in want.items() if v}
    marks = P.nearest_pairs(spark.createDataFrame([(1, "v1", "vector", 0.0, 0.0, 9.0, 1.0)], SCHEMA)).collect()
    assert [(r.source, r.target, r.place) for r in marks] == [("v1", "v1", 0)]


def test_windows_of_a_large_page(spark):
    """A page of 5,000 glyphs: pairs stay linear, and every close pair with a hint is among them."""
    rows = page(5000, 3, 40_000.0)
    df = spark.createDataFrame(rows, SCHEMA).cache()
    got = P.local_pairs(df)
    n = got.count()
    assert n < 5000 * 400
    hinted = {(r[0], r[1]) for r in got.where(f"{G.relation_hint('s_', 't_')} is not null").select("s_node_id", "t_node_id").collect()}
    every = P.twin(df).where("s_node_id <> t_node_id").where(f"{G.relation_hint('s_', 't_')} is not null").select("s_node_id", "t_node_id").collect()
    assert {(r[0], r[1]) for r in every} == hinted
    assert P.nearest_pairs(df).count() == 5000 * P.NEIGHBOURS
