"""Likeness within documents against comparing everything."""

import difflib
import random

from foliogrid.operators import matching as M


def brute(text, others, least, strictly):
    best, at = 0.0, -1
    for i, o in enumerate(others):
        r = difflib.SequenceMatcher(None, text, o).ratio()
        if r > best:
            best, at = r, i
    return (at, best) if at >= 0 and (best > least if strictly else best >= least) else (-1, 0.0)


def test_bounds_lose_nothing():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 40))) for _ in range(6)]
        base = rng.choice(texts)
        texts.append("".join(c for c in base if rng.random() < 0.9))
        for least, strictly in ((0.6, True), (0.88, False)):
            assert M.best_like(base[1:], texts, least, strictly) == brute(base[1:], texts, least, strictly)


def test_likest_of_many_compares_few(monkeypatch):
    rng = random.Random(2)
    for width in (40, 300):
        for _ in range(60):
            texts = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(0, width))) for _ in range(8)]
            texts += ["".join(c for c in rng.choice(texts) if rng.random() < 0.9) for _ in range(3)] + texts[:2]
            for asked in filter(None, (texts[9], texts[3][1:], texts[1] + "é", "zz")):
                for least, strictly in ((0.6, True), (0.88, False)):
                    want = brute(asked, texts, least, strictly)
                    assert M.Likest(texts).best(asked, least, strictly) == want == M.best_like(asked, texts, least, strictly)
    assert M.Likest([]).best("a", 0.6, True) == (-1, 0.0)
    compared = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: compared.append(1) or ratio(self))
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(300)]
    likest = M.Likest(lines)
    assert [likest.best(x, 0.6, True) for x in lines] == [(i, 1.0) for i in range(300)] and not compared
    assert [likest.best(x[:-1] + "#", 0.6, True)[0] for x in lines] == list(range(300)) and len(compared) < 3000


def test_paragraphs_and_blocks(spark):
    clean = [(1, "The first line\nof a paragraph\n\nZhe second paragraph is here\n\n  \n\nA third one, quite different."), (2, None)]
    blocks = [(1, "b0", "The first line of a paragraf"), (1, "b1", "The second paragraph is here"), (1, "b2", "short"), (1, "b3", "nothing of the kind 12345"), (2, "b0", "The second paragraph is here"), (1, "b4", None)]
    got = M.paragraphs_of_blocks(spark.createDataFrame(blocks, "doc_id long, block_id string, content string"), spark.createDataFrame(clean, "doc_id long, text string"))
    assert {(r.doc_id, r.block_id): r.paragraph for r in got.collect()} == {(1, "b0"): "The first line\nof a paragraph", (1, "b1"): "Zhe second paragraph is here"}


def test_paragraphs_are_compared_whole(spark):
    rng = random.Random(4)
    said = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n)).replace("  ", " a").strip()
    head, tail, other = said(250), said(700), said(700)
    clean = [(1, f"{head} {other}\n\n{head} {tail}\n\n{tail}"), (2, f"{head} {other}"), (3, f"{said(250)} {tail}")]
    blocks = [(1, "b0", f"{head} {tail}!"), (1, "b1", f"#{tail}"), (2, "b0", f"{head} {'0123456789' * 70}"), (3, "b0", f"{head} {tail}")]
    got = M.paragraphs_of_blocks(spark.createDataFrame(blocks, "doc_id long, block_id string, content string"), spark.createDataFrame(clean, "doc_id long, text string"))
    assert {(r.doc_id, r.block_id): r.paragraph for r in got.collect()} == {(1, "b0"): f"{head} {tail}", (1, "b1"): tail, (3, "b0"): clean[2][1]}


def test_titles(spark):
    outline = [(1, "introduction", 0), (1, "relatedwork", 3), (1, "relatedworks", 5), (2, "other", 1)]
    asked = [(1, "introduction"), (1, "zntroduction"), (1, "relatedwork"), (1, "conclusion"), (2, "introduction"), (3, "x")]
    got = M.titles_to_outline(spark.createDataFrame(asked, "doc_id long, asked string"), spark.createDataFrame(outline, "doc_id long, title string, page_num int"))
    assert sorted((r.doc_id, r.asked, r.title, r.page_num, r.score) for r in got.collect()) == [(1, "introduction", "introduction", 0, 1.0), (1, "relatedwork", "relatedwork", 3, 1.0), (1, "zntroduction", "introduction", 0, round(22 / 24, 6))]
