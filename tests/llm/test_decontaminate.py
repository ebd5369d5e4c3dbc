import hashlib

from foliogrid.llm import decontaminate as D
from tests.llm.conftest import alnum

ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog again and more"),
    (2, "ein zwei"),
    (3, None),
    (4, "..."),
    (5, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"),
    (10, "ein zwei"),
    (None, "general public license"),
    (1, "the quick brown fox jumps over the lazy dog again and more"),
    (6, "a b c d e f g"),
]


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = alnum(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, own = alnum(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    own |= {str(y) for y in wins[x] if y is not None}
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force_by_an_index_and_by_a_join(spark, odd):
    extra = spark.createDataFrame([(20, "x y a b c d e f g z"), (21, "a b c d e f"), (22, "g a b c d e f g a b c d e f g")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in docs.collect()], ITEMS)
    for block in (D.BLOCK_WINDOWS, 3):
        got = sorted((tuple(r)[:6] for r in D.contamination(docs, bench, block_windows=block).collect()), key=str)
        assert got == want
        kept = D.clean_documents(odd, bench, block_windows=block)
        assert {r[0] for r in kept.collect()} == {3, 4, 5, 9, 10} and kept.columns == odd.columns


def test_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(empty, bench).count() == D.contamination(empty, bench, block_windows=1).count() == 0
    assert {r.n_hit for r in D.contamination(odd, bench.where("false")).collect()} == {0}


def test_real_documents(spark):
    path = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    for block in (D.BLOCK_WINDOWS, 1):
        assert sorted((tuple(r)[:6] for r in D.contamination(docs, bench, block_windows=block).collect()), key=str) == want
        clean = sorted(r[0] for r in D.clean_documents(docs, bench, block_windows=block).collect())
        assert clean == sorted(r[0] for r in want if not r[5])
