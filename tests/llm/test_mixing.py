import math
from collections import defaultdict

from foliogrid.llm import mixing as M
from tests.llm.conftest import spaced


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.SOURCE_WEIGHTS[i % 3] for i, s in enumerate(order)}
    budget, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
            free.remove(s)
    return out


def checked(docs, result):
    rows = [(r.doc_id, r.source, len(spaced(r.text))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    goal = brute_targets(dict(sizes))
    got = result.collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((d, n) for d, _, n in rows), key=str)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        key = (r.source_size, round(r.target, 3))
        taken[key] += r.taken
        largest[key] = max(largest[key], r.size)
        assert 0 <= r.taken <= 2 * r.size
    assert {k for k in taken} == {(sizes[s], round(goal[s], 3)) for s in sizes}
    for k in taken:
        n = sum((sizes[s], round(goal[s], 3)) == k for s in sizes)
        assert abs(taken[k] - n * k[1]) <= n * (largest[k] / 2 + 1)
    return got


def test_targets_and_budgets(spark, odd, empty):
    checked(odd, M.mix(odd))
    assert M.mix(empty).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a = checked(docs, M.mix(docs, M.quality_weights(labels)))
    b = M.mix(docs.repartition(7), M.quality_weights(labels)).collect()
    assert sorted(a) == sorted(b)


def test_prefix_sums_cross_partitions(spark):
    n = 3000
    docs = spark.range(n).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    got = checked(docs, M.mix(docs))
    hot = sorted((r for r in got if r.source_size == sum(1 + i % 7 for i in range(0, n, 3))), key=lambda r: -math.log((int(__import__("hashlib").md5(str(r.doc_id).encode()).hexdigest()[:12], 16) + 0.5) / 2**48))
    partial = [r.times - min(x.times for x in hot) for r in hot]
    assert partial == sorted(partial, reverse=True)  # least keys first


def test_weights_favour_good_documents(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "cast(id % 2 as string) as source")
    weights = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 < 2, 4.0, 0.25) as weight")
    got = M.mix(docs, weights, percent=60).collect()
    good, poor = sum(r.times for r in got if r.doc_id % 4 < 2), sum(r.times for r in got if r.doc_id % 4 >= 2)
    assert good > 1.5 * poor


def test_the_mix_repeats_documents(spark, odd):
    times = defaultdict(int)
    for r in M.mix(odd).collect():
        times[r.doc_id, r.size] += r.times
    out = M.mixed_documents(odd)
    assert out.columns == odd.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, len(spaced(r.text))] += 1
    assert dict(got) == {k: v for k, v in times.items() if v}


def test_words_of_the_mix_with_repeated_rows(spark, empty):
    """A source whose budget ends among rows of one id and size: its documents have just the mix's words."""
    rows = [(1, "a b c d", "x", i) for i in range(40)] + [(2, "a b", "y", i) for i in range(7)] + [(None, "w " * 9, "x", i) for i in range(30)] + [(i, "v " * (i % 5), "z", 0) for i in range(10, 40)]
    rows += [(1, "a b c d", "y", i) for i in range(11)] + [(50, None, None, 0), (50, "q q", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(6)
    mixed = M.mix(docs).collect()
    split = defaultdict(set)
    for r in mixed:
        split[r.doc_id, r.source, r.size].add(r.times)
    assert any(len(x) > 1 for x in split.values()), "no budget ends among equals"
    out = M.mixed_documents(docs)
    words, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        words[r.source] += len(spaced(r.text))
    for r in mixed:
        want[r.source] += r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}
    copies = defaultdict(int)
    for r in out.collect():
        copies[tuple(r)] += 1
    assert max(copies.values()) <= 2 and M.mixed_documents(empty).count() == 0
