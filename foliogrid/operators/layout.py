"""Layout steps whose result depends on order, one page at a time: suppression of overlaps and growing clusters.

A page is a bounded group; nothing crosses pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Boxes of pages that are clustered side by side, or so.
CELLS = 1 << 15


def _shared_of_smaller(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    w = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0])
    h = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1])
    area = np.maximum((others[:, 2] - others[:, 0]) * (others[:, 3] - others[:, 1]), 1e-9)
    own = max((box[2] - box[0]) * (box[3] - box[1]), 1e-9)
    return np.maximum(w, 0) * np.maximum(h, 0) / np.minimum(area, own)


def suppressed(boxes: DataFrame, keys: list[str], least: float = 0.85) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1, score) of a page, in order of ``id``: one that overlaps a kept box takes its place if it scores higher, else it goes."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("id").reset_index(drop=True)
        xy, score = page[["x0", "y0", "x1", "y1"]].to_numpy(float), page["score"].to_numpy(float)
        kept: list[int] = []
        for i in range(len(page)):
            hit = np.flatnonzero(_shared_of_smaller(xy[i], xy[kept]) >= least) if kept else []
            if not len(hit):
                kept.append(i)
            elif score[i] > score[kept[hit[0]]]:
                kept[hit[0]] = i
        return page.iloc[kept]

    return boxes.groupBy(*keys).applyInPandas(run, boxes.schema)


def _clusters(xy: np.ndarray, sizes: np.ndarray, across: float, overhang: float, down: float) -> np.ndarray:
    """The cluster of each box, pages after each other and each from top to bottom: the i-th boxes of pages of about one size join together."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(len(xy), np.int32)
    for level in np.unique(np.frexp(sizes[sizes > 0])[1]):
        alike = np.flatnonzero((np.frexp(sizes)[1] == level) & (sizes > 0))
        alike = alike[np.argsort(-sizes[alike], kind="stable")]
        step = max(1, CELLS >> int(level))
        for own in (alike[i : i + step] for i in range(0, len(alike), step)):
            united, count = np.full((len(own), 1, 4), np.nan), np.zeros(len(own), np.int64)
            for i in range(sizes[own[0]]):
                active = int(np.searchsorted(-sizes[own], -i, "left"))
                at, rows, most = first[own[:active]] + i, np.arange(active), int(count[:active].max())
                if most == united.shape[1]:
                    united = np.concatenate([united, np.full_like(united, np.nan)], axis=1)  # twice as wide
                b, u = xy[at], united[:active, : most + 1]
                x0, y0, x1, y1 = (b[:, None, k] for k in range(4))
                u0, v0, u1, v1 = (u[:, :, k] for k in range(4))
                # a place without a cluster is nan, which is near nothing
                gap_x = np.maximum(0, np.maximum(x0, u0) - np.minimum(x1, u1))
                gap_y = np.maximum(0, np.maximum(y0, v0) - np.minimum(y1, v1))
                tall = np.maximum(np.maximum(y1 - y0, 1), np.maximum(v1 - v0, 1))
                level_with = np.minimum(y1, v1) - np.maximum(y0, v0) >= -1.25 * tall
                over = np.minimum(x1, u1) - np.maximum(x0, u0) >= -overhang
                near = (level_with & (gap_x <= across)) | (over & (gap_y <= down))
                joins = near.any(axis=1)
                k = np.where(joins, np.argmin(np.where(near, gap_x + gap_y, np.inf), axis=1), count[:active])
                old = united[rows, k]
                both = np.concatenate([np.minimum(old[:, :2], b[:, :2]), np.maximum(old[:, 2:], b[:, 2:])], axis=1)
                united[rows, k] = np.where(joins[:, None], both, b)
                count[:active] += ~joins
                out[at] = k
    return out


def clustered(boxes: DataFrame, keys: list[str], across: float = 36.0, overhang: float = 18.0, down: float = 16.0) -> DataFrame:
    """Boxes of a page with ``cluster``, its number on the page.

    From top to bottom, a box joins the nearest cluster whose united box is a neighbour: beside it within ``across``
    and about level, or above or below within ``down``.
    """

    columns = boxes.columns
    names = [c for c in columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = np.diff(np.asarray(lists.offsets))
            page = np.repeat(np.arange(len(sizes)), sizes)
            flat = pa.RecordBatch.from_struct_array(lists.flatten())
            key = pa.table({"page": page, "y0": flat.column("y0"), "x0": flat.column("x0"), "id": flat.column("id")})
            flat = flat.take(pc.sort_indices(key, [(c, "ascending") for c in key.column_names]))
            xy = np.stack([flat.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=1)
            held = {k: batch.column(i).take(pa.array(page)) for i, k in enumerate(keys)} | {c: flat.column(c) for c in names}
            yield pa.RecordBatch.from_arrays([*[held[c] for c in columns], pa.array(_clusters(xy, sizes, across, overhang, down))], [*columns, "cluster"])

    pages = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("__rows"))
    return pages.mapInArrow(run, StructType([*boxes.schema.fields, StructField("cluster", IntegerType())]))
