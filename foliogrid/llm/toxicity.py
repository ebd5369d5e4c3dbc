"""Toxicity: severity by cumulative-link ordinal regression on sparse text features.

P(grade <= g) = sigmoid(cut_g - x.w): one weight vector for all thresholds, ordered cuts. Features are
words and 5-byte windows (A-Z lower-cased), hashed; those that a bounded sample of labelled documents ties to
toxicity are selected, and a document's feature is log(1 + its count). The result is the
expected severity, the sum over g of P(grade > g).

Labels say only whether a document is toxic. Grades of toxic sample documents are made from them:
1 to ``GRADES`` - 1 by how many strong signs they hold, in about equal shares. Any integer
grade column can be given instead.

Defined results: null and empty texts have no features and get the severity of none; labels without a
document, or null, are left out; repeated labels count once; repeated documents give a row each, and of those that
share an id the sample has the one whose text comes first. How rows are dealt changes nothing. With no
toxic or no clean label there is nothing to learn: every severity is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.session import cut

#: Labelled rows that the model is fitted on, at most: the first by a hash of their id.
SAMPLE = 8_000
#: Features of the model, at most, and buckets that they are hashed to.
FEATURES, BITS = 1_024, 20
GRADES = 4
#: A sign of toxicity is so many times more frequent in toxic documents; a strong one twice that.
LIFT = 2
#: Toxic documents of the sample that a sign stands in, at least.
LEAST = 3
#: A cut that no score passes.
NEVER = np.inf
WINDOW = 5
_BYTES = (T._VALUES_LOWER >> T.U(32)).astype(np.uint32)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the window at each byte (its place is its index), buckets of the words, and the words' rows."""
    n = len(data) - WINDOW + 1
    v = _BYTES[data]
    h = np.zeros(max(0, n), np.uint32)
    for i in range(WINDOW if n > 0 else 0):
        h *= np.uint32(0x9E3779B1)
        h += v[i : i + n]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    w = T.split_words(data, offsets, T.ALNUM_ANY)
    half = np.int64(1 << (BITS - 1))
    return (h >> np.uint32(33 - BITS)).astype(np.int64) + half, (w.hashes >> T.U(65 - BITS)).astype(np.int64), w.rows()


def _hits(slots: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of the selected features in each row, ascending."""
    windows, words, word_rows = _buckets(data, offsets)
    s = slots[windows]
    at = np.flatnonzero(s >= 0)
    row = np.searchsorted(offsets, at, "right") - 1
    ok = at + WINDOW <= offsets[row + 1]
    t = slots[words]
    own = t >= 0
    key, count = np.unique(np.concatenate([row[ok] * 65536 + s[at[ok]], word_rows[own] * 65536 + t[own]]), return_counts=True)
    return key >> 16, key & 65535, count


@dataclass
class Model:
    """Selected buckets with weights, and the cuts between grades."""

    buckets: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def slots(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g."""
        edge = self.cuts[None, :] - score[:, None]
        return np.where(edge == NEVER, 0.0, 1 / (1 + np.exp(np.clip(edge, -60, 60))))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, l2: float = 1e-4, steps: int = 600, signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that make the grades likeliest, by resilient gradient steps over all rows; sparse x by (row, column, value).

    ``signs``: features only ever raise the severity, so that long clean passages can't hide a sign.
    """
    n, levels = len(grades), int(grades.max()) if len(grades) else 0
    share = np.array([(grades <= g).mean() for g in range(levels)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    par = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    step, last = np.full_like(par, 0.02), np.zeros_like(par)
    for _ in range(steps):
        w, first, gaps = par[:features], par[features], np.exp(par[features + 1 :])
        cuts = first + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, values * w[cols], n)
        edge = np.concatenate([np.full((n, 1), -np.inf), cuts[None, :] - score[:, None], np.full((n, 1), np.inf)], axis=1)
        below = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
        below[:, 0], below[:, -1] = 0, 1
        hi, lo = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-9)
        slope_hi, slope_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = (slope_hi - slope_lo) / n
        d_w = np.bincount(cols, values * d_score[rows], features) + l2 * w / np.sqrt(1 + w * w)
        d_cut = np.array([-(slope_hi[grades == g].sum() - slope_lo[grades == g + 1].sum()) / n for g in range(levels)])
        grad = np.concatenate([d_w, [d_cut.sum()], [d_cut[g + 1 :].sum() * gaps[g] for g in range(levels - 1)]])
        turn = grad * last
        step = np.clip(np.where(turn > 0, 1.2, np.where(turn < 0, 0.5, 1.0)) * step, 1e-6, 0.5)
        grad[turn < 0] = 0
        par, last = par - np.sign(grad) * step, grad
        par[:features] = np.maximum(par[:features], 0) if signs else par[:features]
    gaps = np.exp(par[features + 1 :])
    return par[:features], par[features] + np.concatenate([[0], np.cumsum(gaps)])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, grades: int = GRADES, grade: str | None = None, tasks: int = 8) -> Model:
    """Fit on ``sample`` labelled documents at most, in ``tasks`` tasks. ``grade``: an integer column of labels to use as it is."""
    level = F.max(grade if grade else toxic).cast("int")
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(grade or toxic).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(level.alias("level"))
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    # rows that share an id are one document of the sample, so it has `sample` rows at most
    texts = cut(texts.repartition(tasks, "__id").groupBy("__id").agg(F.first("level").alias("level"), F.min("text").alias("text")).select("level", "text"))

    def counting(kind: int, wanted=None):
        """Documents of a kind (1: toxic) by bucket, and all of them under -1; of the ``wanted`` buckets alone, if given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, total = np.zeros(1 << BITS, np.int32), 0
            for batch in batches:
                bad = np.asarray(batch.column(0)) > 0
                own = batch.filter(pa.array(bad == bool(kind)))
                for i, j, data, offsets in T.text_steps(own.column(1)):
                    windows, words, word_rows = _buckets(data, offsets)
                    rows = np.searchsorted(offsets, np.arange(len(windows)), "right") - 1
                    ok = np.arange(len(windows)) + WINDOW <= offsets[rows + 1]
                    key = np.concatenate([(rows[ok] << BITS) | windows[ok], (word_rows << BITS) | words])
                    if wanted is not None:
                        key = key[wanted.value[key & ((1 << BITS) - 1)]]
                    np.add.at(counts, np.unique(key) & ((1 << BITS) - 1), 1)
                    total += j - i
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total), pa.int64())], ["bucket", "n"])

        return T.mapped(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    def table(kind: int, least: int, wanted=None) -> tuple[int, np.ndarray]:
        got = counting(kind, wanted).where(F.col("n") >= least).toArrow()  # a row for each of 2^BITS buckets at most
        bucket, n = np.asarray(got.column(0)), np.asarray(got.column(1))
        return int(n[bucket < 0].sum()), np.bincount(bucket[bucket >= 0], n[bucket >= 0], 1 << BITS)

    nothing = Model(np.zeros(0, np.int64), np.zeros(0), np.array([NEVER]))
    n_bad, bad = table(1, LEAST)
    if not n_bad:
        return nothing
    n_good, good = table(0, 1, texts.sparkSession.sparkContext.broadcast(bad > 0))
    if not n_good:
        return nothing
    a, b = bad / n_bad, good / n_good
    z = (a - b) / np.sqrt((a * (1 - a) + 0.5 / n_bad) / n_bad + (b * (1 - b) + 0.5 / n_good) / n_good)
    lift = a / (b + 0.5 / n_good)
    sign = np.flatnonzero((bad > 0) & (lift > LIFT))
    if not len(sign):
        return nothing
    sign = sign[np.lexsort((sign, -z[sign]))][:features]
    model = Model(sign, np.zeros(len(sign)), np.zeros(1))
    slots = texts.sparkSession.sparkContext.broadcast(model.slots())

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.text_steps(batch.column(1)):
                row, slot, n = _hits(slots.value, data, offsets)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                words = np.diff(T.split_words(data, offsets, T.ALNUM_ANY, hashed=False).first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words), T.list_array(pa.array(slot, pa.int64()), ends), T.list_array(pa.array(n, pa.int64()), ends)], ["level", "words", "slots", "counts"])

    got = T.mapped(texts, features_of, "level int, words long, slots array<long>, counts array<long>").orderBy("level", "words", F.xxhash64("slots", "counts")).toArrow()  # `sample` sparse rows
    level = np.asarray(got.column("level")).astype(np.int64)
    slot, n = got.column("slots").combine_chunks(), got.column("counts").combine_chunks()
    rows = np.repeat(np.arange(len(level)), np.diff(np.asarray(slot.offsets)))
    cols, tf = np.asarray(slot.flatten()), np.asarray(n.flatten())
    if grade is None:
        strong = lift[sign] >= 2 * LIFT
        strength = np.bincount(rows, np.log1p(tf) * strong[cols], len(level))
        bad = level > 0
        steps = np.quantile(strength[bad], np.arange(1, grades - 1) / (grades - 1))
        level = np.where(bad, 1 + np.searchsorted(np.unique(steps), strength), 0)
    model.weights, model.cuts = fit_cumulative_link(rows, cols, np.log1p(tf), level, len(sign), signs=True)
    return model


def severity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, severity (expected), grade (likeliest), p_toxic, toxic (p_toxic >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots = m.slots()
        for batch in batches:
            for i, j, data, offsets in T.text_steps(batch.column(1)):
                row, slot, n = _hits(slots, data, offsets)
                above = m.above(np.bincount(row, np.log1p(n) * m.weights[slot], j - i) if len(row) else np.zeros(j - i))
                edges = np.concatenate([np.ones((j - i, 1)), above, np.zeros((j - i, 1))], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(above.sum(axis=1)), pa.array(np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= threshold)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return T.mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")
