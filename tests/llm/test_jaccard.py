import random

import pytest

from foliogrid.llm import jaccard as J
from tests.llm.conftest import spaced


def sets(rows):
    out = []
    for _, text in rows:
        w = spaced(text)
        out.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return out


def brute(rows, percent=90):
    s = sets(rows)
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                group[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(s[i]), ids.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(40)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [t for _ in range(6) for t in family(rng, rng.randrange(2, 14), rng.choice([11, 12, 14, 25, 60, 200]), 3)]
    texts += [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(14))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(docs).collect()), key=str) == brute(rows)


def test_light_sets_alone_and_heavy_sets_alone(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(t for _ in range(5) for t in family(rng, 9, rng.choice([20, 40, 80]), 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for boundary in (0, 10**6, 38):
        monkeypatch.setattr(J, "choose_boundary", lambda *_, b=boundary: b)
        assert sorted(map(tuple, J.jaccard_components(docs, frequent=10).collect()), key=str) == want


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, J.jaccard_components(odd).collect()), key=str) == brute(rows)
    assert J.jaccard_components(empty).count() == 0
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 10]


def test_boundary_follows_cost():
    long = [(200, 10_000, 5.0)]
    alone, shared, crowded = ([(n, 1000, x) for n in range(9, 30)] + long for x in (0.0, 0.8, 9.0))
    assert J.choose_boundary(alone, 90) == 0 and 20 <= J.choose_boundary(shared, 90) <= 29 and J.choose_boundary(crowded, 90) < 20
