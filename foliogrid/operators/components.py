"""Connected components by alternating stars, on edges that never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.session import cut

EDGES_A_TASK = 100_000
#: So few edges (16 bytes each, or so) are joined in one task; any more by stars over all of them.
ONE_TASK = 500_000


def _union_find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}
    kind = None

    def find(x):
        path = []
        while (up := root.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            root[y] = x
        return x

    for edges in parts:
        kind = edges.schema.field(0).type
        for u, v in zip(edges.column(0).to_pylist(), edges.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """``(node, component)`` of every node in an edge; component is its smallest reachable node.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller
    ones; both keep connectivity and the rounds are logarithmic. Each step is a
    grouped minimum (with map-side combine) and one join, so a hub with a third of all edges is no
    single task. Up to ``one_task`` distinct edges, which are counted first, go to one task instead.
    Self loops only register their node. Null ends drop their edge.
    """
    e = (
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)
    count = e.count()
    if count <= one_task:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}")
    # few edges need few tasks: each writes a file for each shuffle
    parts = count // EDGES_A_TASK + 1
    e = e.coalesce(parts)
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.where("u <> v")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts)
        e = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        # small star over (u > v)
        least = e.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        e = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").coalesce(parts).distinct()
        e = cut(e.coalesce(parts))
        # a forest of stars: no parent is itself a child; the sum guards against endless change
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("component")), F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
