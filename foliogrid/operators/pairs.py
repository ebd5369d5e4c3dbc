"""Candidate pairs of a page's nodes, without all pairs of a large page.

Small pages meet in a join on the page, which bounds it at ``ALL`` nodes a side; a larger page goes to Python as a group, where each node
looks only at a window of others. Which way a page goes changes no result that the windows allow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes up to which all of a page are looked at; beyond, the window's reach in heights, places and overlapping nodes.
ALL = 72
REACH, MARGIN, BEFORE, BEHIND, OVERLAPPING = 4.0, 8, 36, 48, 36
NEIGHBOURS, STEP = 16, 0.25


def twin(df: DataFrame, left: str = "s", right: str = "t", key: str = "page_num") -> DataFrame:
    """Pairs of rows on a page: columns of either side with its prefix; pages have the key in common, so no pair crosses one."""
    a = df.select(*[F.col(c).alias(f"{left}_{c}") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"{right}_{c}") for c in df.columns])
    return a.join(b, F.col(f"{left}_{key}") == F.col(f"{right}_{key}"))


def _sides(nodes: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of pages up to ``most`` and of larger ones."""
    sizes = nodes.groupBy(F.col(key).alias("__page")).agg(F.count("*").alias("__n"))
    sized = nodes.join(sizes, F.col(key) == F.col("__page")).drop("__page")
    return sized.where(F.col("__n") <= most).drop("__n"), sized.where(F.col("__n") > most).drop("__n")


def window(x0: np.ndarray, x1: np.ndarray, mid_y: np.ndarray, height: np.ndarray, mid_x: np.ndarray, i: int) -> np.ndarray:
    """Places (by x0) of the nodes that node i looks at: about its reach, its places, and the overlapping ones nearest in height."""
    tall = REACH * max(height[i], 1.0)
    a = max(0, np.searchsorted(x0, x0[i] - tall, "left") - MARGIN)
    b = min(len(x0), np.searchsorted(x0, x1[i] + tall, "right") + MARGIN)
    over = np.flatnonzero(x1[: np.searchsorted(x0, x1[i], "right")] >= x0[i])
    if len(over) > OVERLAPPING:
        over = over[np.lexsort((mid_x[over], np.abs(mid_y[over] - mid_y[i])))[:OVERLAPPING]]
    near = np.arange(max(0, i - BEFORE), min(len(x0), i + BEHIND))
    out = np.unique(np.concatenate([np.arange(a, b), near, over]))
    return out[out != i]


def local_pairs(nodes: DataFrame, key: str = "page_num", node_id: str = "node_id", most: int = ALL) -> DataFrame:
    """``twin`` without a node's pair with itself, on large pages within windows."""
    small, large = sided_pairs(nodes, key, node_id, most)
    return small.unionByName(large)


def sided_pairs(nodes: DataFrame, key: str = "page_num", node_id: str = "node_id", most: int = ALL) -> tuple[DataFrame, DataFrame]:
    """``local_pairs`` of pages up to ``most`` nodes, which lie where their page does, and of larger ones; in a union of both, pairs would be dealt anew."""
    small, large = _sides(nodes, key, most)
    pairs = twin(small, key=key).where(f"s_{node_id} <> t_{node_id}")
    schema = pairs.schema

    def run(page: pd.DataFrame) -> pd.DataFrame:
        mid_y = ((page["y0"] + page["y1"]) / 2).to_numpy()
        order = np.lexsort((page[node_id].to_numpy(str), mid_y, page["x0"].to_numpy()))
        page = page.iloc[order].reset_index(drop=True)
        x0, x1, mid_y = page["x0"].to_numpy(), page["x1"].to_numpy(), mid_y[order]
        height, mid_x = (page["y1"] - page["y0"]).to_numpy(), (x0 + x1) / 2
        found = [window(x0, x1, mid_y, height, mid_x, i) for i in range(len(page))]
        source = np.repeat(np.arange(len(page)), [len(f) for f in found])
        target = np.concatenate(found)
        left, right = page.iloc[source].add_prefix("s_").reset_index(drop=True), page.iloc[target].add_prefix("t_").reset_index(drop=True)
        return pd.concat([left, right], axis=1)

    return pairs, large.groupBy(key).applyInPandas(run, schema)


def nearest(x: np.ndarray, y: np.ndarray, names: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, score) of each node's k nearest, nodes in reading order: distance, and a quarter for each place between.

    Exact: a node ``w`` places away scores w / 4 at least, so a window is wide enough once its k-th score is no more than that.
    """
    n = len(x)
    out = []
    for i in range(n):
        reach = 64
        while True:
            a, b = max(0, i - reach), min(n, i + reach + 1)
            at = np.arange(a, b)
            at = at[at != i]
            score = np.sqrt((x[at] - x[i]) ** 2 + (y[at] - y[i]) ** 2) + np.abs(at - i) * STEP
            order = np.lexsort((names[at], np.round(score, 9)))[:k]
            if (a == 0 and b == n) or (len(order) == k and score[order[-1]] < reach * STEP):
                break
            reach *= 4
        out.append((np.full(len(order), i), at[order], score[order]))
    s, t, score = (np.concatenate(c) if out else np.zeros(0) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return s, t, score


def nearest_pairs(nodes: DataFrame, key: str = "page_num", k: int = NEIGHBOURS, most: int = ALL) -> DataFrame:
    """(key, source, target, place, score): each node's ``k`` nearest on its page, and drawn marks (node_type vector) with themselves at place 0."""
    placed = nodes.select(key, "node_id", "node_type", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.expr(f"row_number() over (partition by {key} order by x0, y0, node_id)").alias("ord"))
    small, large = _sides(placed, key, most)
    score = f"sqrt(power(t_x - s_x, 2) + power(t_y - s_y, 2)) + abs(t_ord - s_ord) * {STEP}D"
    pairs = twin(small, key=key).where("s_node_id <> t_node_id").selectExpr(f"s_{key} as {key}", "s_node_id as source", "t_node_id as target", f"{score} as score")
    ranked = pairs.withColumn("place", F.expr(f"cast(row_number() over (partition by {key}, source order by round(score, 9), target) as int)")).where(F.col("place") <= k)
    ranked = ranked.select(key, "source", "target", "place", "score")

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("ord")
        names = page["node_id"].to_numpy(str)
        s, t, score = nearest(page["x"].to_numpy(), page["y"].to_numpy(), names, k)
        place = np.arange(len(s)) - np.searchsorted(s, s, "left") + 1
        return pd.DataFrame({key: page[key].iloc[0], "source": names[s], "target": names[t], "place": place.astype(np.int32), "score": score})

    selves = nodes.where("node_type = 'vector'").selectExpr(key, "node_id as source", "node_id as target", "0 as place", "0D as score")
    return ranked.unionByName(large.groupBy(key).applyInPandas(run, ranked.schema)).unionByName(selves)
