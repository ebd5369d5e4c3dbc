"""Caches of bounded size, replayed from their requests: a cache is a bounded group of requests in order."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: what an eviction leaves of a cache's size.
KEPT = 0.9


def replay(requests: Iterable[tuple[str, str, int]], most: int, kept: float = KEPT) -> list[tuple[bool, int, int]]:
    """(hit, evicted, size after) of each request (action, key, size).

    ``get`` renews a key; ``put`` adds or replaces it, and beyond ``most`` the keys unused for longest go until no more than ``kept`` of it is left;
    ``drop`` forgets a key.
    """
    held: OrderedDict[str, int] = OrderedDict()
    size, out = 0, []
    for action, key, own in requests:
        hit, gone = key in held, 0
        if action == "get" and hit:
            held.move_to_end(key)
        elif action == "drop":
            size -= held.pop(key, 0)
        elif action == "put":
            size += own - held.pop(key, 0)
            held[key] = own
            while size > (most if not gone else int(most * kept)) and held:
                size -= held.popitem(last=False)[1]
                gone += 1
        out.append((hit, gone, size))
    return out


def replayed(requests: DataFrame, most: int, cache: str = "cache") -> DataFrame:
    """Requests (cache, seq, action, key, size) with hit, evicted and held."""
    from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seq")
        found = replay(zip(own["action"], own["key"], own["size"].astype(int), strict=True), most)
        return own.assign(hit=[f[0] for f in found], evicted=[f[1] for f in found], held=[f[2] for f in found])

    schema = StructType([*requests.schema.fields, StructField("hit", BooleanType()), StructField("evicted", IntegerType()), StructField("held", LongType())])
    return requests.groupBy(cache).applyInPandas(run, schema)
