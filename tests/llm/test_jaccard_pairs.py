"""Pairs that the parities rule out, and what is shuffled for those that they don't."""

import random

import numpy as np

from foliogrid.llm import jaccard as J
from tests.llm.test_jaccard import brute, family


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 600, 9000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for kept in (0, size // 2, size):
            b = np.concatenate([a[:kept], rng.integers(0, 1 << 63, size // 3, dtype=np.uint64)])
            x, y = (np.unpackbits(J._parities(np.unique(s)).view(np.uint8)) for s in (a, b))
            assert (x != y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
            assert len(x) == J.MARKS


def test_links_at_the_limit_of_rows_without_or_with_repeated_ids(spark):
    rng = random.Random(11)
    texts = [t for words in (22, 60, 300, 1500) for t in family(rng, 9, words, words // 20 + 1)]
    rows = [(None if i % 4 == 0 else i % 17, t) for i, t in enumerate(texts) for _ in range(1 + i % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(docs).collect()), key=str) == brute(rows)


def test_pairs_too_different_fetch_no_whole_sets(spark):
    """Families whose members share four fifths of their n-grams, by joins that shuffle: whole sets would go round after round."""
    rng = random.Random(13)
    texts = []
    for f in range(6):
        base = [f"longword{f}x{i}" for i in range(400)]
        texts += [" ".join(w if rng.random() > 0.025 else f"other{rng.randrange(10**6)}" for w in base) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    try:
        assert J.jaccard_components(docs).select("component_id").distinct().count() > 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < 0.6 * sum(map(len, texts))
