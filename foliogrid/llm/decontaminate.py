"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is
``window`` consecutive words of an item; an item with fewer words is one window of its own length. For
windows of L words, k = min(``k``, L): every L consecutive words hold W = L - k + 1 k-grams, the
least of which is kept as a fingerprint on both sides. A document that holds a window thus keeps that
window's fingerprint; each joint fingerprint is extended to the windows round it, which are compared
word by word. So no shared span of a window's length is missed and none is made up.

Defined results: null or blank texts have no words and hit nothing; items without words have no
window; items without an id hit words but are not listed; repeated items count once; repeated
documents give a row each; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.session import cut

K, WINDOW = 5, 10
#: Windows in a broadcast index (about 120 bytes each); a benchmark with more meets documents by a join on fingerprints.
BLOCK_WINDOWS = 250_000
#: Bits of a fingerprint in the bitmap that is broadcast for that join: 2^26 bits are 8 MB.
JOIN_BITS = 26
_BITS = 22


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, words): each distinct window of each item, as the 64-bit hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in T.text_steps(batch.column(1)):
                w = T.split_words(data, offsets, T.ALNUM_ANY)
                rows, words = [], []
                for r in range(j - i):
                    h = w.hashes[w.first[r] : w.first[r + 1]]
                    n = min(window, len(h))
                    for s in range(len(h) - n + 1 if n else 0):
                        rows.append(i + r)
                        words.append(h[s : s + n].tobytes())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(words, pa.binary())], ["item", "words"])

    return T.mapped(benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")), run, "item string, words binary").distinct()


def _starts(w: T.Words, g: np.ndarray, at: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words whose fingerprint is a k-gram at one of the places ``at``, and the fingerprints.

    Winnowing: such a gram is the least of a window of n - k + 1 grams that lies in one row.
    """
    width = n - k + 1
    row = np.searchsorted(w.first, at, "right") - 1
    lo, hi = w.first[row], w.first[row + 1] - k
    starts = []
    for back in range(width):
        s = at - back
        ok = (s >= lo) & (s + width - 1 <= hi)
        s, p = s[ok], at[ok]
        if not len(s):
            continue
        least = g[s].copy()
        for t in range(1, width):
            np.minimum(least, g[s + t], out=least)
        starts.append(s[least == g[p]])
    s = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    least = g[s].copy()
    for t in range(1, width):
        np.minimum(least, g[s + t], out=least)
    return s, least


class Index:
    """Windows of a benchmark by length, with their fingerprints."""

    def __init__(self, rows: list[tuple[str | None, bytes]], k: int = K):
        self.k, self.lengths = k, {}
        self.items: list[list[str]] = []
        groups: dict[bytes, list[str]] = {}
        for item, words in rows:
            own = groups.setdefault(bytes(words), [])
            if item is not None:
                own.append(item)
        by_length: dict[int, list[bytes]] = {}
        for words in groups:
            by_length.setdefault(len(words) // 8, []).append(words)
        for n, all_words in by_length.items():
            m = np.frombuffer(b"".join(all_words), T.U).reshape(-1, n)
            key = T.grams(m.reshape(-1), n)[::n]
            order = np.argsort(key, kind="stable")
            kk = min(k, n)
            g = T.grams(m.reshape(-1), kk)
            marks = np.unique(np.min(np.stack([g[i::n][: len(m)] for i in range(n - kk + 1)]), axis=0))
            seen = np.zeros(1 << _BITS, bool)
            seen[marks >> T.U(64 - _BITS)] = True
            base = len(self.items)
            self.items += [groups[all_words[i]] for i in order]
            self.lengths[n] = (kk, marks, seen, key[order], m[order], base)

    def scan(self, w: T.Words) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Hit words of each word of ``w`` (boolean), and (row, its windows) for rows with any."""
        total = len(w.hashes)
        cover = np.zeros(total + 1, np.int32)
        found_rows, found = [], []
        for n, (k, marks, seen, keys, words, base) in self.lengths.items():
            if total < n:
                continue
            g = T.grams(w.hashes, k)
            # grams across rows may be kept as well: they only add candidates, which must then stay inside a row
            at = np.flatnonzero(seen[g >> T.U(64 - _BITS)])
            at = at[np.isin(g[at], marks)]
            if not len(at):
                continue
            s = _starts(w, g, at, n, k)[0]
            if not len(s):
                continue
            span = w.hashes[s[:, None] + np.arange(n)]
            key = T.grams(span.reshape(-1), n)[::n]
            i = np.searchsorted(keys, key)
            i[i == len(keys)] = 0
            ok = (keys[i] == key) & (words[i] == span).all(axis=1)
            s, i = s[ok], i[ok]
            np.add.at(cover, s, 1)
            np.add.at(cover, s + n, -1)
            found_rows.append(np.searchsorted(w.first, s, "right") - 1)
            found.append(i + base)
        hit = np.cumsum(cover[:-1]) > 0
        if not found:
            return hit, []
        rows, wins = np.concatenate(found_rows), np.concatenate(found)
        order = np.lexsort((wins, rows))
        rows, wins = rows[order], wins[order]
        cuts = np.flatnonzero(np.diff(rows)) + 1
        return hit, [(int(rows[a]), np.unique(wins[a:b])) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def _marked(windows: DataFrame, k: int) -> DataFrame:
    """Windows (item, words) with their fingerprint, ``mark``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            size, marks = np.array([len(x) // 8 for x in words], np.int64), np.zeros(len(words), T.U)
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                g = T.grams(np.frombuffer(b"".join(words[i] for i in own), T.U), min(k, int(n)))
                marks[own] = np.min(np.stack([g[i::n][: len(own)] for i in range(n - min(k, int(n)) + 1)]), axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(T.as_long(marks))], ["item", "words", "mark"])

    return T.mapped(windows, run, "item string, words binary, mark long")


def _bitmap(marked: DataFrame) -> np.ndarray:
    """Which top ``JOIN_BITS`` of a hash fingerprints have: 2^``JOIN_BITS`` bits, however many there are."""
    part = 14
    place = F.shiftrightunsigned("mark", 64 - JOIN_BITS)
    sets = marked.select(place.alias("place")).distinct().groupBy(F.shiftright("place", part).alias("part")).agg(F.collect_set(F.col("place").bitwiseAND((1 << part) - 1)).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                bits = np.zeros(1 << part, bool)
                bits[np.asarray(batch.column(1)[r].values)] = True
                rows.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["part", "bits"])

    out = np.zeros((1 << (JOIN_BITS - part), 1 << (part - 3)), np.uint8)
    got = T.mapped(sets, run, "part long, bits binary").toArrow()  # 2^(JOIN_BITS - 14) rows of 2 KB at most
    for at, bits in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        out[at] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _joined(docs: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(key, n_hit, items) of texts with hits, from (key, text), for a benchmark of any size.

    One pass over the texts keeps the windows whose fingerprint the bitmap doesn't rule out; they meet the benchmark's by a join
    on fingerprint and words. A passage that many documents or items hold is a skewed key that adaptive execution splits.
    """
    marked = cut(_marked(windows, k))
    lengths = sorted(r[0] // 8 for r in marked.select(F.octet_length("words")).distinct().collect())  # `window` rows at most
    known = docs.sparkSession.sparkContext.broadcast(_bitmap(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in T.text_steps(batch.column(1)):
                w = T.split_words(data, offsets, T.ALNUM_ANY)
                for n in lengths:
                    kk = min(k, n)
                    if len(w.hashes) < n:
                        continue
                    g = T.grams(w.hashes, kk)
                    place = (g >> T.U(64 - JOIN_BITS)).astype(np.int64)
                    s, least = _starts(w, g, np.flatnonzero(known.value[place >> 3] >> (place & 7).astype(np.uint8) & 1), n, kk)
                    row = np.searchsorted(w.first, s, "right") - 1
                    for a in range(0, len(s), 8192):
                        at = s[a : a + 8192]
                        words = w.hashes[at[:, None] + np.arange(n)]
                        raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 8 * n).astype(np.int32)), pa.py_buffer(words.tobytes())])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row[a : a + 8192])), pa.array(at - w.first[row[a : a + 8192]]), pa.array(T.as_long(least[a : a + 8192])), raw], ["key", "start", "mark", "words"])

    spots = T.mapped(docs, run, "key string, start long, mark long, words binary")
    found = spots.join(marked, ["mark", "words"]).select("key", F.struct("start", (F.col("start") + F.octet_length("words") / 8).cast("long").alias("end")).alias("span"), "item")
    grouped = found.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    # spans in order of their starts: each adds what reaches beyond the ones before
    step = "(a, s) -> named_struct('n', a.n + greatest(0L, s.end - greatest(a.end, s.start)), 'end', greatest(a.end, s.end))"
    return grouped.select("key", F.expr(f"aggregate(spans, named_struct('n', 0L, 'end', 0L), {step}, a -> a.n)").alias("n_hit"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (listed)."""
    windows = cut(item_windows(benchmark, item_id, item_text, window))
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if windows.count() <= block_windows:
        index = slim.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in windows.collect()], k))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, tuple[int, str, list[str]]] = {}
            none = (0, hashlib.sha256(b"").hexdigest(), [])
            for batch in batches:
                for i, j, data, offsets in T.text_steps(batch.column(1)):
                    w = T.split_words(data, offsets, T.ALNUM_ANY)
                    hit, found = index.value.scan(w)
                    counts = np.concatenate([[0], np.cumsum(hit)])
                    n_hit = counts[w.first[1:]] - counts[w.first[:-1]]
                    each = [none] * (j - i)
                    for r, wins in found:
                        if (name := wins.tobytes()) not in known:
                            items = sorted({x for y in wins for x in index.value.items[y]})
                            if len(known) > 50_000:
                                known.clear()
                            known[name] = (len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), items)
                        each[r] = known[name]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array(np.diff(w.first)), pa.array(n_hit), pa.array([x[0] for x in each], pa.int64()), pa.array([x[1] for x in each]), pa.array(n_hit > 0), pa.array([x[2] for x in each], pa.list_(pa.string()))],
                        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
                    )

        return T.mapped(slim, run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.text_steps(batch.column(1)):
                w = T.split_words(data, offsets, T.ALNUM_ANY, hashed=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(w.first))], ["doc_id", "own_key", "n_words"])

    # equal texts have equal hits
    counted = T.mapped(slim.withColumn("own_key", F.md5("text")), count, f"doc_id {kind}, own_key string, n_words long")
    joined = counted.join(_joined(slim.select(F.md5("text").alias("key"), "text"), windows, k), F.col("own_key") == F.col("key"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), items.alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without a hit word, with all their columns as they are."""
    windows = cut(item_windows(benchmark, item_id, item_text, window))
    if windows.count() > block_windows:
        gone = _joined(docs.select(F.md5(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text")), windows, k).select(F.col("key").alias("__gone"))
        return docs.join(gone, F.md5(F.col(f"`{text}`")) == F.col("__gone"), "left_anti")
    at = docs.columns.index(text)
    index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in windows.collect()], k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for i, _, data, offsets in T.text_steps(batch.column(at)):
                for r, _ in index.value.scan(T.split_words(data, offsets, T.ALNUM_ANY))[1]:
                    good[i + r] = False
            yield batch.filter(pa.array(good))

    return T.mapped(docs, run, docs.schema)
