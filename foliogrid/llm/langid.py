"""Language ID by Bayesian evidence fusion.

For each row and language l, the posterior is in proportion to

    prior(l | host) * P(declared | l) * P(suffix | l) * P(text | l)

* text: 3-byte windows (A-Z lower-cased) under a model of each language, fitted on a bounded sample of labelled documents. The mean
  over the whole text counts as ``n / (1 + n / EVIDENCE)`` windows, as neighbours overlap. A class ``und`` for no known language has all windows alike.
* declared: the language that the markup (or a column) declares, by how often texts of each language declare it.
* suffix: the last label of the address, likewise.
* host: shares of languages among the host's rows, smoothed towards those of its domain, and these towards those of
  all rows; a row's own text is left out of its host's and domain's shares.

All three tables are grouped sums of the text's own posteriors, so a host with a third of all rows is summed in
parts before the shuffle.

Defined results: without letters in the text the other evidence decides, but a null or letterless text whose
evidence says nothing either is ``und``; a null declaration, host or suffix is no evidence; repeated rows give
a row each; an empty table gives no rows. ``rejected`` is true for ``und`` and for texts without letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.session import cut, small

#: Labelled rows of each language that its model is fitted on, at most: the first by a hash of their id.
SAMPLE = 1_500
EVIDENCE = 200.0
UND = "und"
UND_PRIOR = 1e-3
#: Sums by host and other evidence that one task holds, or so.
GROUPS_A_TASK = 100_000
_BITS = 16
_BYTES = (T._VALUES_LOWER >> T.U(32)).astype(np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True


@dataclass
class TextModel:
    """Log-likelihoods of windows by language; the last class is ``und``."""

    languages: list[str]
    table: np.ndarray  # (windows, classes)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tempered log-likelihoods (row, class), the posteriors that they give alone (0 without letters), and numbers of letters.

        A row beyond a step's bytes is a step of its own; it is read in blocks, so memory doesn't follow its length.
        """
        rows, k = len(offsets) - 1, self.table.shape[1]
        sums, n, letters = np.zeros((rows, k)), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for at in range(0, max(len(data), 1), T.STEP):
            part = data[at : at + T.STEP + 2]
            own = np.clip(offsets - at, 0, len(part))
            b, row_of = _windows(part, own, min(T.STEP, len(part)))
            first = np.searchsorted(row_of, np.arange(rows + 1))
            full = np.flatnonzero(np.diff(first))
            if len(full):
                sums[full] += np.add.reduceat(self.table[b], first[full], axis=0, dtype=np.float64)
            n += np.diff(first)
            held = np.concatenate([[0], np.cumsum(_LETTER[part[: T.STEP]])])
            own = np.minimum(own, T.STEP)
            letters += held[own[1:]] - held[own[:-1]]
        ll = sums / np.maximum(n, 1)[:, None] * (n / (1 + n / EVIDENCE))[:, None]
        return ll, np.where(letters[:, None] > 0, _soft(ll), 0.0), letters


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-byte windows that stay in their row and hold a letter, and their rows; ``most``: windows from the first bytes alone."""
    n = len(data) - 2 if most is None else min(most, len(data) - 2)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = _BYTES[data]
    h = (v[:n] * np.uint32(0x9E3779B1) + v[1 : n + 1]) * np.uint32(0x85EBCA6B) + v[2 : n + 2]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    letter = _LETTER[data]
    ok = letter[:n] | letter[1 : n + 1] | letter[2 : n + 2]
    edge = offsets[1:-1]
    for back in (1, 2):
        at = edge - back
        ok[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(ok)
    return (h[at] >> np.uint32(32 - _BITS)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, least: int = 1) -> TextModel:
    """Fit text models on labelled documents, ``sample`` of each language at most.

    Every language with a window of text has a model, unless ``least`` asks for more rows. The same 0.02 of each bucket are added
    to every language's counts, 1,311 windows in all: a rare language's model is mostly flat, a large one's hardly moves.
    """
    marked = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(lang).alias("lang"))
    # a language's rows below a share of the hash's range are a few times the sample: no window gets all rows of a language
    share = marked.groupBy(F.col("lang").alias("__l")).agg((3.0 * sample / F.count("*")).alias("__share"))
    near = marked.join(small(share), F.col("lang") == F.col("__l")).where((F.col("__share") >= 1) | (F.shiftrightunsigned(F.xxhash64("__id"), 11) / float(1 << 53) < F.col("__share")))
    chosen = near.withColumn("rank", F.expr("row_number() over (partition by lang order by shiftrightunsigned(xxhash64(__id), 11), __id)")).where(F.col("rank") <= sample).select("__id", "lang").distinct()
    texts = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text"), F.col(lang).alias("__lang")).join(small(chosen), (F.col("__doc") == F.col("__id")) & (F.col("__lang") == F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, _, data, offsets in T.text_steps(batch.column(1)):
                b, row = _windows(data, offsets)
                for name in set(langs[i : i + len(offsets) - 1]):
                    own = langs[i + row] == name if len(row) else np.zeros(0, bool)
                    counts[name] = counts.get(name, 0) + np.bincount(b[own], minlength=1 << _BITS)
                    rows[name] = rows.get(name, 0) + int((langs[i : i + len(offsets) - 1] == name).sum())
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], rows[name]), pa.int64())], ["lang", "bucket", "n"])

    sums = T.mapped(texts, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # 2^16 buckets of each language at most
    langs, buckets, n = np.array(got.column(0).to_pylist(), object), np.asarray(got.column(1)), np.asarray(got.column(2))
    names = sorted(x for x in set(langs[buckets >= 0]) if n[(langs == x) & (buckets == -1)].sum() >= least)
    table = np.full((1 << _BITS, len(names) + 1), -np.log(1 << _BITS), np.float32)
    for c, name in enumerate(names):
        own = (langs == name) & (buckets >= 0)
        dense = np.bincount(buckets[own], n[own], 1 << _BITS) + 0.02
        table[:, c] = np.log(dense / dense.sum())
    return TextModel(names, table)


#: Columns that scoring adds: log-likelihoods and posteriors by class, and letters.
_SCORES = {"__ll": "array<double>", "__own": "array<double>", "__letters": "long"}


def _scored(rows: DataFrame, model: TextModel, text: str, html: str | None) -> DataFrame:
    """The rows without their text, with ``_SCORES``, kept in the shared folder. ``html``: a boolean column, true for markup."""
    at = rows.columns.index(text)
    mark = rows.columns.index(html) if html else None
    shared = rows.sparkSession.sparkContext.broadcast(model)
    classes = len(model.languages) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [x for x in range(batch.num_columns) if x != at]
            for i, j, data, offsets in T.text_steps(batch.column(at)):
                if mark is not None:
                    data, offsets = _visible(data, offsets, np.asarray(batch.column(mark).slice(i, j - i).fill_null(False)))
                ll, own, letters = shared.value.scores(data, offsets)
                ends = np.arange(j - i + 1) * classes
                kept = [batch.column(x).slice(i, j - i) for x in rest]
                yield pa.RecordBatch.from_arrays([*kept, T.list_array(pa.array(ll.reshape(-1)), ends), T.list_array(pa.array(own.reshape(-1)), ends), pa.array(letters)], [*(batch.schema.names[x] for x in rest), *_SCORES])

    return cut(T.mapped(rows, run, T.wider(rows.drop(text).schema, **_SCORES)))


def _visible(data: np.ndarray, offsets: np.ndarray, html: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of markup without their tags."""
    keep = np.ones(len(data), bool)
    inside = False  # a row of many blocks: whether a tag is open where the block begins
    for at in range(0, len(data), T.STEP):
        part = data[at : at + T.STEP]
        own = np.clip(offsets - at, 0, len(part)).astype(np.int32)
        place = np.arange(1, len(part) + 1, dtype=np.int32)
        opened, closed = np.maximum.accumulate(np.where(part == 60, place, 0)), np.maximum.accumulate(np.where(part == 62, place, 0))
        start = np.repeat(own[:-1], np.diff(own))
        tag = (opened > closed) & (opened > start)
        if inside:
            tag |= (opened == 0) & (closed == 0)
        inside = bool(tag[-1])
        keep[at : at + len(part)] = ~((tag | (part == 62)) & np.repeat(html, np.diff(own)))
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def fuse(scored: DataFrame, model: TextModel, declared: str, suffix: str, domain: str, host: str, ids: list[str]) -> DataFrame:
    """(ids, lang, confidence, rejected, letters) of scored rows.

    Priors are grouped sums of the rows' own posteriors. Their tables are joined to the rows by key; a row without a
    key meets nothing and goes where its number sends it, so rows without one are no hot key. What is joined is narrow.
    """
    names = [*model.languages, UND]
    k = len(names)
    c = F.col
    base = scored.select(c(declared).alias("d"), c(suffix).alias("x"), c(domain).alias("m"), c(host).alias("h"), "__own")
    sums = [F.sum(F.element_at("__own", i + 1)).alias(f"n{i}") for i in range(k)]
    *total, groups = base.agg(*sums, F.approx_count_distinct(F.struct("d", "x", "m", "h"))).first()
    # few groups need few tasks, each of which writes a file
    by_all = cut(base.groupBy("d", "x", "m", "h").agg(*sums).coalesce(groups // GROUPS_A_TASK + 1))
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    whole = np.array([float(x or 0) for x in total])
    share = (whole + 0.5) / (whole + 0.5).sum()
    share[-1] = UND_PRIOR
    share /= share.sum()

    out = scored.withColumn("__number", F.monotonically_increasing_id())
    tables = [("__host", "h", host), ("__domain", "m", domain), ("__suffix", "x", suffix), ("__declared", "d", declared)]
    for name, key, col in tables:
        sums = by_all.where(c(key).isNotNull()).groupBy(c(key).alias("__key")).agg(*again)
        sums = sums.select("__key", F.array(*[f"n{i}" for i in range(k)]).alias(name))
        meets = F.coalesce(c(col), F.concat(F.lit("\0"), F.pmod("__number", F.lit(1 << 16)).cast("string")))
        out = out.join(small(sums), (meets == c("__key")) & c(col).isNotNull(), "left").drop("__key")
    slim = out.select(*ids, "__ll", "__own", "__letters", *[name for name, _, _ in tables], F.col(declared).isNull().alias("__undeclared"), F.col(host).isNull().alias("__homeless"))
    at = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """(row, class) and whether the row has any; 0 where not."""
            there = np.asarray(column.is_valid())
            dense = np.zeros((len(column), k))
            dense[there] = np.asarray(column.drop_null().flatten()).reshape(-1, k)
            return dense, there

        for batch in batches:
            ll, own = vectors(batch.column(at))[0], vectors(batch.column(at + 1))[0]
            letters = np.asarray(batch.column(at + 2))
            others, there = zip(*[vectors(batch.column(at + 3 + i)) for i in range(4)], strict=True)
            # a row's own text is no evidence for it
            host_n, domain_n, suffix_n, declared_n = (np.where(t[:, None], np.maximum(x - own, 0), 0.0) for x, t in zip(others, there, strict=True))
            near = (domain_n + 20.0 * share) / (domain_n.sum(axis=1, keepdims=True) + 20.0)
            prior = (host_n + 10.0 * near) / (host_n.sum(axis=1, keepdims=True) + 10.0)
            total = np.log(np.maximum(prior, 1e-9)) + np.where(letters[:, None] > 0, ll, 0.0)
            # P(value | l) up to a factor: rows of l with the value, over all rows of l
            for n, t in ((suffix_n, there[2]), (declared_n, there[3])):
                total += np.where(t[:, None], np.log((n + 1.0) / (whole + 20.0)), 0.0)
            post = _soft(total) if len(total) else total
            best = post.argmax(axis=1) if len(total) else np.zeros(0, np.int64)
            silent = (letters == 0) & np.asarray(batch.column(at + 7)) & np.asarray(batch.column(at + 8))
            best[silent] = k - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([names[x] for x in best], pa.string()), pa.array(post.max(axis=1) if len(total) else np.zeros(0)), pa.array((best == k - 1) | (letters == 0)), pa.array(letters)], [*ids, "lang", "confidence", "rejected", "letters"])

    return T.mapped(slim, run, T.wider(slim.select(*ids).schema, lang="string", confidence="double", rejected="boolean", letters="long"))


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address; null where there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(found != "", found)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1)
    suffix = F.regexp_extract(host, r"\.([^.]+)\.?$", 1)
    return host, F.when(domain != "", domain).otherwise(host), F.when(suffix != "", suffix)


def declared_in(html: Column) -> Column:
    """The language that the html element declares, in its short form; null where there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]{0,500}?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def identify(rows: DataFrame, model: TextModel, ids: list[str], text: str, html: str | None, declared: str, host: str, domain: str, suffix: str) -> DataFrame:
    """ids, lang, confidence, rejected, letters: a row for each row."""
    slim = rows.select(*[F.col(f"`{c}`") for c in ids], F.col(text).alias("__text"), F.col(declared).alias("__declared_in"), F.col(host).alias("__host_in"), F.col(domain).alias("__domain_in"), F.col(suffix).alias("__suffix_in"), *([F.col(html).alias("__html")] if html else []))
    return fuse(_scored(slim, model, "__text", "__html" if html else None), model, "__declared_in", "__suffix_in", "__domain_in", "__host_in", ids)


def known_language(docs: DataFrame, model: TextModel, text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The documents that are not rejected, with their columns as they are; ``host``: a column that acts as one.

    Equal texts with the same declaration and host get the same answer, so what is rejected is known by these (the text by its MD5):
    texts are scored once and stay where they are.
    """
    none = F.lit(None).cast("string")

    def key(prefix: str) -> list[Column]:
        return [F.md5(F.encode(F.col(f"`{text}`"), "utf-8")).alias(f"{prefix}t"), F.col(f"`{declared}`").cast("string").alias(f"{prefix}d"), F.col(f"`{host}`").cast("string").alias(f"{prefix}h")]

    light = docs.select(F.col(f"`{text}`").alias("__text"), *key("__"), none.alias("__none"))
    said = fuse(_scored(light, model, "__text", None), model, "__d", "__none", "__none", "__h", ["__t", "__d", "__h"])
    gone = cut(said.where("rejected").select("__t", "__d", "__h").distinct())
    columns = docs.columns
    wide = docs.select(*[F.col(f"`{c}`") for c in columns], *key("__own_"))
    same = F.col("__own_t").eqNullSafe(F.col("__t")) & F.col("__own_d").eqNullSafe(F.col("__d")) & F.col("__own_h").eqNullSafe(F.col("__h"))
    return wide.join(small(gone), same, "left_anti").select(*[F.col(f"`{c}`") for c in columns])
