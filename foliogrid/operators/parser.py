"""A relation parser: features of glyph pairs, a small network fitted on a bounded sample, and its relations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.functions import geometry as G

#: Pairs that the network is fitted on, at most: the first by a hash of their ids.
SAMPLE = 20_000
FEATURES = list(G.edge_features("s_", "t_"))


@dataclass
class Network:
    """Normalisation, hidden layers and output of a classifier."""

    labels: list[str]
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a = (x - self.mean) / self.scale
        for w, b in self.layers[:-1]:
            a = np.maximum(0, a @ w + b)
        z = np.clip(a @ self.layers[-1][0] + self.layers[-1][1], -80, 80)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(samples: DataFrame, hidden: int = 24, rounds: int = 300, seed: int = 1) -> Network:
    """A network for (FEATURES, relation, weight) of ``SAMPLE`` rows at most; classes weigh inversely to the root of their share."""
    rows = samples.orderBy(F.xxhash64("pair_id"), "pair_id").limit(SAMPLE).select(*FEATURES, "relation", "weight").toPandas()
    labels = sorted(set(rows["relation"]))
    x, y = rows[FEATURES].to_numpy(float), np.array([labels.index(r) for r in rows["relation"]])
    share = np.bincount(y, rows["weight"], len(labels))
    weight = rows["weight"].to_numpy(float) * np.sqrt(share.mean() / share)[y]
    weight /= weight.sum()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = (x - mean) / scale
    rng = np.random.default_rng(seed)
    w1, b1 = rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden)
    w2, b2 = rng.standard_normal((hidden, len(labels))) * np.sqrt(1 / hidden), np.zeros(len(labels))
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w1, b1, w2, b2)]
    for step in range(1, rounds + 1):
        h = np.maximum(0, a @ w1 + b1)
        z = h @ w2 + b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        d = p * weight[:, None]
        dh = (d @ w2.T) * (h > 0)
        for (value, m, v), grad in zip(state, (a.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)), strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Network(labels, mean, scale, [(w1, b1), (w2, b2)])


def predicted(pairs: DataFrame, network: Network) -> Column:
    """``struct<relation, confidence>`` of each pair by its features; the network goes to workers once."""
    shared = pairs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("relation string, confidence double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        n = shared.value
        for columns in parts:
            p = n.probabilities(np.column_stack([c.to_numpy(float) for c in columns]))
            best = p.argmax(axis=1)
            yield pd.DataFrame({"relation": [n.labels[i] for i in best], "confidence": p[np.arange(len(p)), best]})

    return run(*[F.col(c) for c in FEATURES])
