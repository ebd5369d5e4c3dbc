import random

import regex

from foliogrid.llm import licenses as L
from tests.llm.conftest import alnum


def brute(text):
    """n_words, n_base, first and last word, base labels: by comparing words at every place."""
    w, out = alnum(text), []
    for x in L.BASE:
        p = x.phrase.split()
        out += [(i, x.label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(out), min((i for i, _ in out), default=None), max((i for i, _ in out), default=None), ",".join(sorted({y for _, y in out}))


def edits(a, b):
    """Least edits of characters between two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def runs_within(text, notice):
    """(first word, last word, edits) of all runs of words that are a notice but for its edits at most."""
    w, out = alnum(text), []
    size = notice.phrase.count(" ") + 1
    for i in range(len(w)):
        for j in range(i + max(0, size - notice.edits - 1), min(len(w), i + size + notice.edits)):
            said = " ".join(w[i : j + 1])
            if abs(len(said) - len(notice.phrase)) <= notice.edits and (e := edits(said, notice.phrase)) <= notice.edits:
                out.append((i, j, e))
    return out


def fuzzed(rng, phrase, n):
    """A phrase with n edits of letters at random places."""
    out = list(phrase)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("abcxyz")
        elif kind == 1 and len(out) > 3:
            del out[i]
        else:
            out.insert(i, rng.choice("abcxyz"))
    return "".join(out)


def test_base_places(odd, empty):
    got = L.license_report(odd)
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got.collect()) == sorted(str((r.doc_id, *brute(r.text))) for r in odd.collect())
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got.count() == odd.count() and L.license_report(empty).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert (by[10].n_base, by[10].first_word, by[10].last_word) == (2, 2, 4) and by[None].base_labels == "cc-by,gpl"


def test_base_places_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in L.license_report(docs).collect())
    assert got == sorted(str((r.doc_id, *brute(r.text))) for r in docs.collect())


def test_fuzzy_notices(spark):
    rows = [
        (1, "Some text.\nLicenced under the Apache-License, Versoin 2.0\nmore"),
        (2, "Permission is hereby granted, free of charg, to any persn obtaining a copy of"),
        (3, "licensed under completely different conditions than apache 2 0 would ask for"),
        (4, "al rights reserved. All rights reserved"),
        (5, "gnu general pubic license"),
    ]
    got = {r.doc_id: r for r in L.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2.0" and got[1].n_base == 0 and 0 < got[1].score < 1
    assert got[2].labels == "mit" and got[3].labels == "" and got[3].score == 0
    assert got[4].labels == "reserved" and got[4].n_base == 1 and got[4].score == 1 and len(got[4].spans) == 3
    assert got[5].labels == "gpl" and got[5].base_labels == ""


def test_fuzzy_spans_against_all_runs_of_words(spark):
    """Notices with edits among other words: every one is found, each span is a run of words within its edits, labels and score follow."""
    rng = random.Random(11)
    fill = "lorem ipsum dolor sit amet under the any copy work rights license general".split()
    rows = []
    for i in range(120):
        parts, planted = [], []
        for _ in range(rng.randrange(1, 4)):
            parts += [rng.choice(fill) for _ in range(rng.randrange(6))]
            x = rng.choice(L.NOTICES)
            parts.append(fuzzed(rng, x.phrase, rng.randrange(x.edits + 1)))
            planted.append(x)
        rows.append((i, " ".join(parts), planted))
    got = {r.doc_id: r for r in L.license_report(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, text, _ in rows:
        r = got[i]
        want = {x: runs_within(text, x) for x in L.NOTICES}
        by_label = {}
        for s in r.spans:
            if not s["base"]:
                by_label.setdefault(s["label"], []).append(s)
                assert any((s["first_word"], s["last_word"], s["edits"]) in [(a, b, e) for a, b, e in runs] or (s["first_word"], s["last_word"]) in [(a, b) for a, b, _ in runs] for x, runs in want.items() if x.label == s["label"]), (text, s)
        # a run that no reported span of its notice touches would be a miss
        for x, runs in want.items():
            for a, b, _ in runs:
                assert any(s["first_word"] <= b and s["last_word"] >= a for s in by_label.get(x.label, [])), (text, x, a, b)
        labels = {s["label"] for s in r.spans}
        assert r.labels == ",".join(sorted(labels)) and abs(r.score - max((1 - s["edits"] / s["length"] for s in r.spans), default=0.0)) < 1e-12


def test_pigeonhole_pieces_cover_the_phrase():
    for x in L.NOTICES:
        parts = L.pieces(x.phrase, x.edits)
        assert len(parts) == x.edits + 1 and b"".join(p for _, p in parts) == x.phrase.encode()
    assert regex.__version__
