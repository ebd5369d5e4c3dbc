"""Texts matched by their likeness (matching blocks' share, Ratcliff and Obershelp), within a document.

A ratio is 2 m / (a + b) for m characters in common, so 2 min(a, b) / (a + b) bounds it by lengths alone, and the characters that two
texts share, whatever their order, bound it closer: pairs beyond a bound are left out before any is compared, and none that counts is lost.
Documents are the groups: nothing is compared across them.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIKE, SHORTEST = 0.6, 10
SAME_TITLE = 0.88


def best_like(text: str, others: list[str], least: float, strictly: bool) -> tuple[int, float]:
    """(place, ratio) of the first of the likest texts; place -1 if none reaches ``least`` (or, ``strictly``, passes it)."""
    if text and text in others:  # a ratio of 1, which only equal texts have
        return (others.index(text), 1.0) if 1.0 > least or not strictly and least == 1.0 else (-1, 0.0)
    best, at = 0.0, -1
    matcher = difflib.SequenceMatcher(None, autojunk=True)
    for i, other in enumerate(others):
        size = len(text) + len(other)
        if not size or 2 * min(len(text), len(other)) / size < max(least, best):
            continue
        # the order of the two and which one is indexed both count in a ratio
        matcher.set_seqs(text, other)
        if matcher.quick_ratio() < max(least, best):
            continue
        ratio = matcher.ratio()
        if ratio > best:
            best, at = ratio, i
    return (at, best) if at >= 0 and (best > least if strictly else best >= least) else (-1, 0.0)


class Likest:
    """``best_like`` for many texts against the same others.

    Equal ones are looked up; the rest are tried in order of the bound by characters in common, worked out for all others at once, until
    no bound reaches the best ratio. Equal ratios go to the first other, as there. Without ``autojunk`` frequent characters of texts of
    200 and more count as well.
    """

    def __init__(self, others: list[str], autojunk: bool = True):
        self.others, self.autojunk = others, autojunk
        self.first = {x: i for i, x in reversed(list(enumerate(others)))}
        self.counts: tuple[dict[str, int], np.ndarray, np.ndarray] | None = None

    def _bounds(self, text: str) -> np.ndarray:
        if self.counts is None:
            place = {c: i for i, c in enumerate(sorted(set("".join(self.others))))}
            table = np.zeros((len(self.others), len(place)), np.uint8 if max(map(len, self.others)) < 256 else np.int32)
            for i, x in enumerate(self.others):
                for c, n in Counter(x).items():
                    table[i, place[c]] = n
            self.counts = place, table, np.array([len(x) for x in self.others])
        place, table, sizes = self.counts
        own = [(place[c], n) for c, n in Counter(text).items() if c in place]
        both = np.minimum(table[:, [c for c, _ in own]], np.array([n for _, n in own])).sum(axis=1, dtype=np.int64)
        return 2.0 * both / np.maximum(sizes + len(text), 1)

    def best(self, text: str, least: float, strictly: bool) -> tuple[int, float]:
        if not self.others:
            return -1, 0.0
        if text and text in self.first:
            return (self.first[text], 1.0) if 1.0 > least or not strictly and least == 1.0 else (-1, 0.0)
        bound = self._bounds(text)
        best, at = 0.0, -1
        matcher = difflib.SequenceMatcher(None, autojunk=self.autojunk)
        near = np.flatnonzero(bound >= least)
        for i in near[np.argsort(-bound[near], kind="stable")].tolist():
            if bound[i] < best:
                break
            matcher.set_seqs(text, self.others[i])
            ratio = matcher.ratio()
            if ratio > best or ratio == best and i < at:
                best, at = ratio, i
        return (at, best) if at >= 0 and (best > least if strictly else best >= least) else (-1, 0.0)


def paragraphs(text: str) -> list[str]:
    """What stands between blank lines, without white space at its ends."""
    return [p.strip() for p in (text or "").split("\n\n") if p.strip()]


def paragraphs_of_blocks(blocks: DataFrame, clean: DataFrame, least: float = LIKE) -> DataFrame:
    """(doc_id, block_id, paragraph, score): for each block (doc_id, block_id, content) the likest paragraph of its document's clean text
    (doc_id, text), if it is liker than ``least``; blocks of fewer than ``SHORTEST`` characters have none. Both are compared whole, however long.

    A text goes to Python once for each batch of its blocks; equal blocks of a document are compared once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[str, tuple[list[str], Likest, dict[str, tuple[int, float]]]] = {}
            rows = []
            for doc, block, content, text in zip(batch["doc_id"], batch["block_id"], batch["content"], batch["text"], strict=True):
                if text not in held:
                    every = paragraphs(text)
                    held[text] = (every, Likest(every, autojunk=False), {})
                own, likest, known = held[text]
                if content not in known:
                    known[content] = likest.best(content, least, True)
                at, score = known[content]
                if at >= 0:
                    rows.append((doc, block, own[at], round(score, 6)))
            yield pd.DataFrame(rows, columns=["doc_id", "block_id", "paragraph", "score"])

    kept = blocks.select("doc_id", "block_id", F.trim("content").alias("content")).where(F.length("content") >= SHORTEST)
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ("doc_id", "block_id"))
    return kept.join(clean.select("doc_id", "text"), "doc_id").mapInPandas(run, f"{kinds}, paragraph string, score double")


def titles_to_outline(asked: DataFrame, outline: DataFrame, least: float = SAME_TITLE) -> DataFrame:
    """(doc_id, asked, title, page_num, score): the outline's title (doc_id, title, page_num) that each asked one (doc_id, asked) means: the same
    one, else the likest of ``least`` at least, the first on ties by page. An outline is one row of its document's titles, in order of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, titles, pages in zip(batch["doc_id"], batch["asked"], batch["titles"], batch["pages"], strict=True):
                own = list(titles)
                at, score = (own.index(text), 1.0) if text in own else best_like(text, own, least, False)
                if at >= 0:
                    rows.append((doc, text, own[at], int(pages[at]), round(score, 6)))
            yield pd.DataFrame(rows, columns=["doc_id", "asked", "title", "page_num", "score"])

    listed = outline.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "title"))).alias("o")).select("doc_id", F.col("o.title").alias("titles"), F.col("o.page_num").alias("pages"))
    kind, page = asked.schema["doc_id"].dataType.simpleString(), outline.schema["page_num"].dataType.simpleString()
    return asked.select("doc_id", "asked").join(listed, "doc_id").mapInPandas(run, f"doc_id {kind}, asked string, title string, page_num {page}, score double")
