"""Line dedup by pairwise alignment.

A line is what stands between newlines, without blanks at its ends, A-Z lower-cased. Each run of consecutive lines that just
makes up ``MIN_WORDS`` words, counted from its first line on or from its last line back, links its later documents to its first one,
however many documents have it: every line of a common block is in such a run of the block, so some document with that run is aligned.
Shorter lines of several documents but no more than half of all are rare; they link likewise documents that share ``MIN_WORDS`` words of
them in all. Linked documents are aligned by patience diff: lines that are unique on both sides anchor a longest increasing run, equal
neighbours extend it, and gaps are aligned in the same way; where no line is unique, the common run of most words is the anchor.
Common blocks of ``MIN_WORDS`` words or more are deleted from the later document.

Linking to the first document keeps pairs linear in lines, however many documents share a line. A line is
deleted only where an earlier document has it, so its first document always keeps it.

Defined results: documents are ordered by id, null last, then by digest; rows that share id and text are
one document and get the same result; null texts have no lines and stay null; blank lines match
nothing and stay; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.session import BROADCAST_ROWS, cut

MIN_WORDS = 20
RARE_SHARE = 0.5
#: Places of cut lines that are broadcast, 4 bytes each; more are joined by a shuffle.
BROADCAST_PLACES = 8_000_000


def _lines(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row; hashes and word counts of lines (0: blank); the lines' bounds by row; digests of rows."""
    for i, j, data, offsets in T.text_steps(column):
        # a row ends a line, as does each newline
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([offsets[:-1], breaks + 1])
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        row_of = np.concatenate([np.arange(j - i), np.searchsorted(offsets, breaks, "right") - 1])[order]
        by_row = np.lexsort((np.arange(len(starts)), row_of))  # empty rows share their start with the next
        starts, row_of = starts[by_row], row_of[by_row]
        bounds = np.searchsorted(row_of, np.arange(j - i + 1))
        w = T.split_words(data, offsets, T.SPACED, hashed=False)
        first = np.searchsorted(w.starts, starts)
        after = np.append(first[1:], len(w.starts))
        words = after - first
        full = words > 0
        hashes = np.zeros(len(starts), T.U)
        hashes[full] = T.hash_spans(data, w.starts[first[full]], w.ends[after[full] - 1])
        text = T.hash_spans(data, offsets[:-1], offsets[1:], lower=False) if j - i == 1 or np.all(np.diff(offsets) > 0) else _each(data, offsets)
        yield i, hashes, words, bounds, text


def _runs(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shortest runs of ``least`` words from each line on and from each line back, and their bounds by row."""
    n = len(hashes)
    at = np.arange(n)
    row = np.searchsorted(bounds, at, "right") - 1
    sums = np.concatenate([[0], np.cumsum(words)])
    # blank lines and rows' ends break runs
    blanks = np.append(np.flatnonzero(words == 0), n)
    stop = np.minimum(blanks[np.searchsorted(blanks, at)], bounds[row + 1])
    blanks = np.concatenate([[-1], blanks])
    start = np.maximum(blanks[np.searchsorted(blanks, at, "right") - 1] + 1, bounds[row])
    ends = np.searchsorted(sums, sums[:-1] + least)
    firsts = np.searchsorted(sums, sums[1:] - least, "right") - 1
    on = np.flatnonzero((words > 0) & (ends <= stop))
    back = np.flatnonzero((words > 0) & (firsts >= start))
    back = back[ends[firsts[back]] != back + 1]  # else it is a run from its first line on too
    first, end = np.concatenate([on, firsts[back]]), np.concatenate([ends[on], back + 1])
    order = np.argsort(first, kind="stable")
    first, end = first[order], end[order]
    out = hashes[first]
    more = np.arange(len(first))
    step = 1
    while len(more := more[first[more] + step < end[more]]):
        with np.errstate(over="ignore"):
            out[more] = T.mix(out[more] * T.U(0x9E3779B97F4A7C15) + hashes[first[more] + step])
        step += 1
    return out, np.searchsorted(first, bounds)


def _each(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digests of rows of which some are empty."""
    out = np.zeros(len(offsets) - 1, T.U)
    full = np.flatnonzero(np.diff(offsets) > 0)
    out[full] = T.hash_spans(data, offsets[full], offsets[full + 1], lower=False)
    return out


def longest_run(a: list[int], b: list[int], words: list[int]) -> tuple[int, int, int, int]:
    """(words, place in a, place in b, lines) of the common run with most words, by a suffix automaton of a; 0 matches nothing."""
    step: list[dict[int, int]] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for i, x in enumerate(a):
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        new, p = len(step) - 1, last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] != length[p] + 1:
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(end[q])
                twin = len(step) - 1
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    best = (0, 0, 0, 0)
    state = lines = held = 0
    for j, x in enumerate(b):
        while state and (x == 0 or x not in step[state]):
            state = link[state]
            held -= sum(words[j - lines : j - length[state]])
            lines = length[state]
        if x and x in step[state]:
            state, lines, held = step[state][x], lines + 1, held + words[j]
        if held > best[0]:
            best = (held, end[state] - lines + 1, j - lines + 1, lines)
    return best


def patience(a: list[int], b: list[int], a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None, words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b) of equal lines, both ascending; 0 matches nothing.

    ``words``: of lines of b, 1 each by default; runs of lines that aren't unique anchor from ``least`` words on.
    """
    words = [1] * len(b) if words is None else words
    out: list[tuple[int, int]] = []
    todo = [(a0, len(a) if a1 is None else a1, b0, len(b) if b1 is None else b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0] != 0:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1] != 0:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if x and in_a[x] == 1 and in_b.get(x) == 1}
        run = [(place[x], i) for i, x in enumerate(b[b0:b1], b0) if x in place]
        # longest increasing run of places in a
        tops: list[int] = []
        piles: list[int] = []
        back = [-1] * len(run)
        for i, (p, _) in enumerate(run):
            k = bisect_left(tops, p)
            if k == len(tops):
                tops.append(p)
                piles.append(i)
            else:
                tops[k], piles[k] = p, i
            back[i] = piles[k - 1] if k else -1
        i = piles[-1] if piles else -1
        end_a, end_b = a1, b1
        if i < 0:
            # equal ends are gone: no pair of this range goes on with a block outside, so shorter runs delete nothing
            if sum(words[q] for q in range(b0, b1) if b[q] and b[q] in in_a) >= least:
                held, p, q, n = longest_run(a[a0:a1], b[b0:b1], words[b0:b1])
                if held >= least:
                    p, q = a0 + p, b0 + q
                    out += [(p + k, q + k) for k in range(n)]
                    todo += [(a0, p, b0, q), (p + n, a1, q + n, b1)]
            continue
        while i >= 0:
            p, q = run[i]
            out.append((p, q))
            todo.append((p + 1, end_a, q + 1, end_b))
            end_a, end_b = p, q
            i = back[i]
        todo.append((a0, end_a, b0, end_b))
    return sorted(out)


def blocks_to_delete(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Places in b of lines in aligned common blocks of ``least`` words at least; ``words``: of lines of b."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for p, q in [*patience(a, b, words=words, least=least), (-9, -9)]:
        if (p, q) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= least:
                out += block
            block = []
        block.append(q)
        last = (p, q)
    return out


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, rare_share: float = RARE_SHARE) -> DataFrame:
    """(id, digest, removed): places of the lines to delete, for documents with any."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, hashes, words, bounds, digest in _lines(batch.column(1)):
                runs, at = _runs(hashes, words, bounds, min_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(digest)), pa.array(T.as_long(digest)), T.list_array(pa.array(T.as_long(hashes)), bounds), T.list_array(pa.array(words.astype(np.int32)), bounds), T.list_array(pa.array(T.as_long(runs)), at)],
                    ["id", "digest", "lines", "words", "runs"],
                )

    lines = T.mapped(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), run, f"id {kind}, digest long, lines array<long>, words array<int>, runs array<long>")
    lines = lines.groupBy("id", "digest").agg(F.first("lines").alias("lines"), F.first("words").alias("words"), F.first("runs").alias("runs")).withColumn("node", F.monotonically_increasing_id())
    lines = cut(lines)
    total = lines.count()
    # lines of enough words are runs; a run's words are put down as `min_words`, those of a line are fewer
    short = F.filter(F.arrays_zip(F.col("lines").alias("line"), F.col("words").alias("words")), lambda x: (x["line"] != 0) & (x["words"] < min_words))
    runs = F.transform("runs", lambda x: F.struct(x.alias("line"), F.lit(min_words).cast("int").alias("words")))
    each = lines.select(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "node").alias("place"), F.explode(F.array_distinct(F.concat(short, runs))).alias("line")).select("place", "line.line", "line.words")
    rare = each.groupBy("line").agg(F.count("*").alias("docs"), F.min("place").alias("first"), F.max("words").alias("most")).where((F.col("docs") > 1) & ((F.col("most") >= min_words) | (F.col("docs") <= max(2.0, rare_share * total))))
    linked = each.join(rare.select("line", "first"), "line").where(F.col("place.node") != F.col("first.node"))
    pairs = linked.groupBy(F.col("place.node").alias("node"), F.col("first.node").alias("earlier")).agg(F.sum("words").alias("shared")).where(F.col("shared") >= min_words).select("node", "earlier")
    a = lines.select(F.col("node").alias("earlier"), F.col("lines").alias("a"))
    b = lines.select("node", "id", "digest", F.col("lines").alias("b"), "words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                out += [blocks_to_delete(x, y, w, min_words) for x, y, w in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["node", "removed"])

    aligned = T.mapped(pairs.join(a, "earlier").join(b, "node").select("node", "a", "b", "words"), align, "node long, removed array<int>").where(F.size("removed") > 0)
    merged = aligned.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    return cut(merged.join(lines.select("node", "id", "digest"), "node").select("id", "digest", "removed"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, rare_share: float = RARE_SHARE) -> DataFrame:
    """All documents and columns with the repeated blocks cut out of their texts, and ``__removed``, the cut lines' places."""
    gone = removals(docs, doc_id, text, min_words, rare_share).select(F.col("id").alias("__id"), F.col("digest").alias("__gone"), F.col("removed").alias("__removed"))
    held = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("__removed")), F.lit(0))).first()
    if held[0] <= BROADCAST_ROWS and held[1] <= BROADCAST_PLACES:
        gone = F.broadcast(gone)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, _, digest in _lines(batch.column(at)):
                own = batch.slice(i, len(digest))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(T.as_long(digest))], [*own.schema.names, "__digest"])

    marked = T.mapped(docs, run, T.wider(docs.schema, __digest="long"))
    joined = marked.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__gone")), "left")
    # places by a set difference, so that a long document costs its lines once
    lines = F.split(F.col(f"`{text}`"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    cleaned = F.when(F.col("__removed").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], "__removed")
