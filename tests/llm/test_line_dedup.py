import hashlib
import random

import numpy as np

from foliogrid.llm import line_dedup as L


def line(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_patience_aligns_common_runs():
    assert L.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert L.patience([9, 1, 2, 8], [7, 1, 2, 6]) == [(1, 1), (2, 2)]
    assert L.patience([1, 2, 3, 4], [3, 4, 1, 2]) in ([(0, 2), (1, 3)], [(2, 0), (3, 1)])
    assert L.patience([5, 0, 6], [5, 0, 6]) == [(0, 0), (2, 2)] and L.patience([], [1]) == []
    rng = random.Random(4)
    for _ in range(300):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(12))], [rng.randrange(6) for _ in range(rng.randrange(12))]
        got = L.patience(a, b)
        assert all(a[p] == b[q] != 0 for p, q in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_blocks_of_enough_words_go_from_the_later_document(spark):
    x, y, z = line(30, "x"), line(12, "y"), line(12, "z")
    docs = [
        (1, f"{x}\n{y}\n{z}\nown one"),
        (2, f"intro\n  {x.upper()}  \nend"),
        (3, f"{y}\n{z}\nthree"),
        (4, f"{y}\nfour\n{z}"),
        (5, f"{x}\n{y}\n{z}\nown one"),
        (6, f"a\n{line(30, 'six')}\nb\n{line(30, 'six')}"),
        (7, None),
        (8, ""),
        (9, "\n\n"),
        (10, "short line"),
        (11, "short line"),
    ]
    df = spark.createDataFrame([(*d, [0]) for d in docs], "doc_id long, text string, removed array<int>")
    got = {r.doc_id: r.text for r in L.deduplicated(df, rare_share=0.9).collect()}
    want = dict(docs) | {2: "intro\nend", 3: "three", 5: ""}
    assert got == want and L.deduplicated(df).columns == [*df.columns, "__removed"]
    assert L.deduplicated(df.where("false")).count() == 0


def test_a_line_is_kept_by_its_first_document(spark):
    rng = random.Random(1)
    lines = [line(25, f"p{i}_") for i in range(12)] + ["", "tiny"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in L.deduplicated(df).collect()}
    seen = set()
    for i, text in docs:
        for x in text.split("\n"):
            if x not in seen:
                assert x in got[i]
        seen |= set(text.split("\n"))
    assert sum(map(len, got.values())) < 0.5 * sum(len(t.split("\n")) for _, t in docs)


def test_odd_rows(spark, odd):
    got = L.deduplicated(odd).collect()
    assert len(got) == odd.count()
    assert {(r.doc_id, hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else None) for r in got} == {(r.doc_id, hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else None) for r in odd.collect()}


def test_passage_whose_lines_have_different_first_holders_goes(spark):
    lines = [line(5, f"s{i}_") for i in range(8)]
    docs = [
        (1, "\n".join([lines[0], lines[1], lines[2], "one"])),
        (2, "\n".join([lines[3], lines[4], lines[5], "two"])),
        (3, "\n".join([lines[6], lines[7], "three"])),
        (4, "\n".join(["four", *lines, "end four"])),
        (5, "\n".join(["five", *lines[:3], "", *lines[3:6], "end five"])),
        (6, "\n".join(["six", *lines, "end six"])),
        (7, "\n".join(["seven", *lines[2:7], "end seven"])),
        (8, "\n".join(["eight", line(30, "l"), lines[0], "end eight"])),
        (9, "\n".join(["nine", line(30, "l"), lines[0], "end nine"])),
    ]
    docs += [(i, f"own {i}") for i in range(10, 30)]
    got = {r.doc_id: r.text for r in L.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs) | {6: "six\nend six", 7: "seven\nend seven", 9: "nine\nend nine"}


def test_every_line_of_a_block_is_in_a_run_of_it():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([0, 1, 2, 5, 9, 25]) for _ in range(rng.randrange(1, 40))]
        cuts = sorted({0, len(words), *(rng.randrange(len(words) + 1) for _ in range(3))})
        hashes = np.array([0 if w == 0 else rng.randrange(1, 2**63) for w in words], np.uint64)
        runs, at = L._runs(hashes, np.array(words), np.array(cuts), 20)
        for row, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want = set()
            for i in range(s, e):
                for j in range(i + 1, e + 1):
                    block = words[i:j]
                    if 0 not in block and sum(block) >= 20 and (sum(block[1:]) < 20 or sum(block[:-1]) < 20):
                        want.add((i, j))
            own = runs[at[row] : at[row + 1]]
            assert len(own) == len(want) == len(set(own.tolist()))
            for i in range(s, e):
                for j in range(i + 1, e + 1):
                    if 0 not in words[i:j] and sum(words[i:j]) >= 20:
                        assert {x for p, q in want if i <= p and q <= j for x in range(p, q)} == set(range(i, j))


def test_ranges_without_unique_lines_anchor_on_a_common_run(spark):
    assert L.patience([1, 2, 7, 1, 2], [9, 1, 2, 8]) in ([(0, 1), (1, 2)], [(3, 1), (4, 2)])
    assert len(L.patience([1, 2, 7, 1, 2], [9, 1, 2, 8, 1, 2, 6])) == 4
    assert L.patience([5, 1, 2, 7, 1, 2, 4], [5, 9, 1, 2, 8, 3], words=[1] * 6, least=3) == [(0, 0)]
    rng = random.Random(7)
    for _ in range(500):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(14))], [rng.randrange(4) for _ in range(rng.randrange(14))]
        words = [rng.randrange(1, 9) if x else 0 for x in b]
        found, p, q, n = L.longest_run(a, b, words)
        assert a[p : p + n] == b[q : q + n] and 0 not in b[q : q + n] and sum(words[q : q + n]) == found
        assert found == max((sum(words[j : j + k]) for i in range(len(a)) for j in range(len(b)) for k in range(1, 14) if a[i : i + k] == b[j : j + k] and i + k <= len(a) and j + k <= len(b) and 0 not in b[j : j + k]), default=0)
        got = L.patience(a, b, words=words)
        assert all(a[x] == b[y] != 0 for x, y in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    passage = "\n".join(line(6, f"p{i}_") for i in range(9))
    docs = [(1, f"{passage}\none\n{passage}"), *((i, f"start {i}\n{passage}\nend {i}") for i in (2, 3)), *((i, f"own {i}") for i in range(4, 12))]
    got = {r.doc_id: r.text for r in L.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs) | {i: f"start {i}\nend {i}" for i in (2, 3)}


def test_passages_of_most_documents_go(spark):
    passage = "\n".join(line(6, f"c{i}_") for i in range(6))
    docs = [(1, f"one\n{passage}"), (2, f"two\n{passage}"), (3, f"three\n{passage}\n{line(25, 'w')}"), (4, f"four\n{line(25, 'w')}"), (5, f"five\n{line(25, 'w')}")]
    got = {r.doc_id: r.text for r in L.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs) | {2: "two", 3: f"three\n{line(25, 'w')}", 4: "four", 5: "five"}


def all_pairs(rows, least=L.MIN_WORDS):
    """Texts after every document was aligned with every earlier one, whatever they share."""
    keyed = []
    for d, text in rows:
        lines = (text or "").split("\n")
        own = [" ".join(x.split()).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in lines]
        keyed.append((d, text, lines, own))
    keyed.sort(key=lambda r: r[0])
    names, out, codes = {}, {}, []
    for d, text, lines, own in keyed:
        words = [len(x.split()) for x in own]
        b = [names.setdefault(x, len(names) + 1) if x else 0 for x in own]
        gone = set()
        for a in codes:
            if set(a) & set(b) - {0}:
                gone |= set(L.blocks_to_delete(a, b, words, least))
        codes.append(b)
        out[d] = text if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = all_pairs(rows)
    got = {r.doc_id: r.text for r in L.deduplicated(docs).collect()}
    assert {d for d in want if got[d] != want[d]} == set() and any(want[d] != t for d, t in rows)


def test_passages_in_order_equal_all_pairs(spark):
    """Passages of many short lines, put together in one order with lines of their own between: which earlier document has which differs."""
    rng = random.Random(9)
    passages = [[line(rng.randrange(2, 9), f"p{k}l{i}w") for i in range(rng.randrange(3, 9))] for k in range(12)]
    rows = []
    for d in range(150):
        parts = []
        for k in sorted(rng.sample(range(12), rng.randrange(1, 5))):
            a = rng.randrange(len(passages[k]))
            parts += [line(rng.randrange(1, 6), f"d{d}k{k}x"), *passages[k][a if rng.random() < 0.5 else 0 :]]
        rows.append((d, "\n".join(parts)))
    got = {r.doc_id: r.text for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = all_pairs(rows)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {} and sum(want[d] != t for d, t in rows) > 50


def test_ten_lines_first_seen_in_ten_documents(spark):
    lines = [line(8, f"s{i}") for i in range(10)]
    rows = [(i, f"{x}\nown line {i}") for i, x in enumerate(lines)] + [(20, "\n".join(lines)), (21, "\n".join(lines))]
    got = {r.doc_id: r.text for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "\n".join(lines) and got[21] == ""
