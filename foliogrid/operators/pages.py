"""Python steps that work on a page at a time, many pages a call: what a call costs is not paid for each of millions of small pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pages whose rows are Python objects at once.
PAGES = 500


def gathered(sides: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """A row for each page of any side: its keys, and for each side its rows there as an array of structs, in no order."""
    rows = [[c for c in df.columns if c not in keys] for df in sides]
    kinds = [F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType) for df, names in zip(sides, rows, strict=True)]
    tagged = [df.select(*keys, *[(F.struct(*names) if i == j else kinds[j]).alias(f"__side{j}") for j in range(len(sides))]) for i, (df, names) in enumerate(zip(sides, rows, strict=True))]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    return every.groupBy(*keys).agg(*[F.collect_list(f"__side{j}").alias(f"__side{j}") for j in range(len(sides))])


def _rows(lists: pa.Array) -> list[list[tuple]]:
    ends = np.asarray(lists.offsets)
    flat = lists.flatten()
    rows = list(zip(*[c.to_pylist() for c in flat.flatten()], strict=True))
    ends = (ends - ends[0]).tolist()
    return [rows[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def mapped_pages(sides: Sequence[DataFrame], keys: Sequence[str], run: Callable[..., Iterable[tuple]], columns: str) -> DataFrame:
    """Keys and ``columns`` from ``run(rows, ...)`` of each page, with a list of tuples of each side's other columns, in their order."""
    kinds = ", ".join(f"{k} {sides[0].schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                held = [c.to_pylist() for c in part.columns[:n]]
                out = [(*key, *row) for key, *rows in zip(zip(*held, strict=True), *map(_rows, part.columns[n:]), strict=True) for row in run(*rows)]
                made = zip(*out, strict=True) if out else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow, strict=True)], names=arrow.names)

    return gathered(sides, keys).mapInArrow(several, schema)
