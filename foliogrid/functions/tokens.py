"""Tokens of texts by Arrow batches, where nested array functions in SQL are many times dearer.

Texts come lower-cased by Spark; a token is a run of ``[a-z0-9_]`` or one CJK character, as in ``functions.text``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.functions.text import STOP_WORDS
from foliogrid.session import importable

TOKEN = re.compile("[a-z0-9_]+|[一-鿿]")
_STOP = frozenset(STOP_WORDS)
_ASCII = re.compile("[a-z0-9_]+")
#: Tokens whose forms a worker remembers; past it, it starts anew.
REMEMBERED = 500_000


def forms(token: str) -> list[str]:
    """The token and its simple English variants; nothing for a stop word."""
    if token in _STOP:
        return []
    out, n = [token], len(token)
    if not _ASCII.fullmatch(token):
        return out
    if n > 4 and token.endswith("ies"):
        out.append(token[:-3] + "y")
    elif n > 4 and token.endswith("s"):
        out.append(token[:-1])
    if n > 5 and token.endswith("ing"):
        out += [token[:-3], token[:-3] + "e"]
    if n > 4 and token.endswith("ed"):
        out.append(token[:-2])
    return out


class _Forms(dict):
    def __missing__(self, token: str) -> list[str]:
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = out = forms(token)
        return out


_forms = _Forms()


def retrieval_tokens(lowered: str) -> list[str]:
    known = _forms
    return [t for w in TOKEN.findall(lowered) for t in known[w]]


def pairs(tokens: list[str]) -> list[str]:
    """Neighbours, joined by an underscore."""
    return [f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)]


def token_digests(text: str) -> Column:
    """``struct<n, tokens, bigrams>`` of a column: how many retrieval tokens, and the MD5 of them and of their pairs, each joined by blanks."""

    @F.pandas_udf("n int, tokens string, bigrams string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own = retrieval_tokens(t or "")
            rows.append((len(own), hashlib.md5(" ".join(own).encode()).hexdigest(), hashlib.md5(" ".join(pairs(own)).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n", "tokens", "bigrams"])

    return run(F.lower(text))


def with_retrieval_tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ct): the retrieval tokens of each row's text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: retrieval_tokens(t or ""))

    return rows.select(key, run(F.lower(text)).alias("ct"))


def field_postings(rows: DataFrame, key: str, weights: dict[str, float], wanted: frozenset[str] | None = None) -> DataFrame:
    """(key, tokens, terms, tfs): how many tokens a row's fields have, its distinct terms and their weighted counts, in one pass.

    ``wanted``: terms to keep; all by default.
    """
    importable(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(wanted)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, terms, tfs = [], [], []
                for fields in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True):
                    total, sums = 0, {}
                    for text, weight in zip(fields, weights.values(), strict=True):
                        counts = Counter(TOKEN.findall(text)) if text else {}
                        total += sum(counts.values())
                        for term, c in counts.items():
                            if keep is None or term in keep:
                                sums[term] = sums.get(term, 0.0) + weight * c
                    n.append(total)
                    terms.append(list(sums))
                    tfs.append(list(sums.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.float64()))], [key, "tokens", "terms", "tfs"])

    return rows.select(key, *[F.lower(f).alias(f) for f in weights]).mapInArrow(run, f"{key} {kind}, tokens long, terms array<string>, tfs array<double>")
