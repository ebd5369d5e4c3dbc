import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliogrid.llm import ann as A


def recall(spark, df, **options):
    m = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, v = np.array([r[0] for r in m]), np.array([r[1] for r in m], np.float64)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 50 == 0, **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -2
        top = set(ids[np.lexsort((ids, -s))[:5]])
        own = got[ids[q]]
        assert sorted(own) == [1, 2, 3, 4, 5]
        scores = [own[i][1] for i in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
        for x, score in own.values():
            assert abs(score - s[np.flatnonzero(ids == x)[0]]) < 1e-12
        hit += len(top & {x for x, _ in own.values()})
        total += 5
    return hit / total


def test_recall(spark, tmp_path):
    assert recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.95
    # clusters of uneven size, a hot one, copies, and vectors without a cluster
    rng = np.random.default_rng(5)
    n, d = 50_000, 32
    centres = rng.standard_normal((300, d))
    own = np.minimum(rng.geometric(0.02, n), 300) - 1
    own[: n // 3] = 7
    v = (centres[own] + 0.35 * rng.standard_normal((n, d))).astype(np.float32)
    v[-5000:] = rng.standard_normal((5000, d))
    v[100:300] = v[100]
    order = rng.permutation(n)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v[order].reshape(-1)), d).cast(pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    assert recall(spark, spark.read.parquet(f"{tmp_path}/v.parquet")) >= 0.9
    # two levels: 40 cells, 600 lists
    assert recall(spark, spark.read.parquet(f"{tmp_path}/v.parquet"), cells=40, lists=600) >= 0.9


def every(rows):
    """The nearest of all candidates of each query, rows by place: (query id, [(id, score)])."""
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scaled = [(i, v / np.abs(v).max()) for i, v in fine]
    out = []
    for a, (qi, q) in enumerate(scaled):
        found = [(-round(float((v * q).sum() / np.sqrt((v * v).sum() * (q * q).sum())), 9), vi) for b, (vi, v) in enumerate(scaled) if b != a]
        out.append((qi, [(vi, -s) for s, vi in sorted(found)[:5]]))
    return sorted(out)


def test_defined_results(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 1.0]), (8, [1.0, 0.875]), (9, []), (None, [1.0, 1.0]), (0, [-1.0, 0.0]), (10, [1e300, 0.0]), (2, [2.0, 0.0]), (11, [1e-300, 3e-300])]
    df = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = []
    for r in A.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got.append((r.query_id, r.rank, r.vec_id, round(r.score, 9)))
    want = [(q, i, v, round(s, 9)) for q, found in every(rows) for i, (v, s) in enumerate(found, 1)]
    assert sorted(got) == sorted(want) and {r[0] for r in got} == {0, 1, 2, 8, 10, 11}
    other = A.nearest(df, df.where("vec_id = 2")).collect()  # another table: rows of the query's id aren't candidates
    assert {r.vec_id for r in other} == {1, 10, 8, 11} and len(other) == 10
    assert A.nearest(df.where("false"), F.lit(True)).count() == 0 and A.nearest(df.where("vec_id in (3, 4)"), F.lit(True)).count() == 0 and A.nearest(df, F.lit(None).cast("boolean")).count() == 0


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else [float(x) for x in rng.standard_normal(4)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = A.nearest(df, F.col("vec_id").isin(1, 1001)).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [2, 4, 5, 7, 8] + [1, 2, 4, 5, 7]
