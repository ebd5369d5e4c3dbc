"""Approximate nearest neighbours by cosine: inverted lists with adaptive dimension scan.

Vectors are normalised and dealt to the nearest of some centroids, fitted on a bounded sample. A query probes
its nearest lists, as many as the sample needs for ``RECALL``. Inside a list, vectors are rotated at random and read in blocks of columns: after d of D
dimensions the partial distance, scaled by D / d, estimates the whole one, and a candidate is
abandoned once it exceeds the k-th best distance by more than a hypothesis test allows (``EPSILON`` / sqrt(d)). What
survives all blocks gets its exact cosine, in double precision on the original vectors.

Every vector is in a list; lists are scanned in chunks of vectors and of queries, so neither a list nor a very
common vector is ever one task. The number of lists grows with the root of the number of vectors: beyond ``LISTS`` there are two levels, cells of
fitted centroids and in each of them vectors of a bounded sample that stand for lists, so a vector looks at the cells and then at one cell's lists.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those of another length than the most common one (the shortest of these on ties); rows that share an id are candidates and queries
of their own, and only a query's own row is no candidate of it (where queries are another table, rows with the query's id);
a query with fewer candidates than k has all of them; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.session import cut

K = 5
#: Vectors that centroids are fitted on, at most (and no more than this many numbers): the first by a hash of their id.
SAMPLE, SAMPLE_NUMBERS = 20_000, 20_000_000
LISTS = 2_048
#: Lists of the second level, at most: as many vectors are on the driver and in a broadcast.
MOST_LISTS = 65_536
#: Share of the nearest vectors that probed lists should hold; the number of probes follows from that share in the sample.
RECALL, TUNED = 0.975, 512
EPSILON = 2.1
COLUMNS = 16
VECTORS, QUERIES = 4_096, 1_024
_FIRST, _BATCH, _FEW = 256, 256, 0.15


def usable(vectors: DataFrame, vec_id: str, vector: str, length: int | None = None, *more: Column) -> DataFrame:
    """(vec_id, v, more) of the vectors that take part: of the most common length, or of the one given."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), *more)
    if length is not None:
        return kept.where(F.size("v") == length)
    common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return kept.where(F.size("v") == (common[0] if common else 0))


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten()).astype(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


class Lists:
    """Centroids of cells and, on the second level, of the lists in each cell; unit vectors."""

    def __init__(self, cells: np.ndarray, members: np.ndarray | None = None):
        self.cells, self.lists, self.first = cells, cells, None
        if members is not None:
            cell = np.argmax(members @ cells.T, axis=1)
            bare = np.setdiff1d(np.arange(len(cells)), cell)  # a cell without members is its own list
            members, cell = np.concatenate([members, cells[bare]]), np.concatenate([cell, bare])
            order = np.argsort(cell, kind="stable")
            self.lists, self.first = members[order], np.searchsorted(cell[order], np.arange(len(cells) + 1))

    def of(self, unit: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        cell = np.argmax(unit @ self.cells.T, axis=1)
        if self.first is None:
            return cell
        out = np.empty(len(unit), np.int64)
        for c in np.unique(cell):
            own = cell == c
            a, b = self.first[c], self.first[c + 1]
            out[own] = a + np.argmax(unit[own] @ self.lists[a:b].T, axis=1)
        return out


def probes_for(sample: np.ndarray, lists: Lists, k: int, target: float) -> int:
    """The fewest probes that hold ``target`` of the k nearest sample vectors of some of them."""
    asked = sample[:TUNED]
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    near = lists.of(sample)
    order = np.argsort(-(asked @ lists.lists.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(lists.lists))[None, :], axis=1)
    ranks = np.sort(rank[np.arange(len(asked))[:, None], near[top]].ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else 1


def _scaled(m: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that no square overflows; cosines are the same to the last bit."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) if len(m) else m


def scan(vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, rotated: np.ndarray, rotated_queries: np.ndarray, ids: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, exact cosine), by places, of the k best candidates of each query in a chunk of a list.

    ``own``: which vectors are no candidates of which query; ``rotated``: unit vectors; ``vectors`` and ``queries`` are the original ones, scaled.
    """
    d = vectors.shape[1]
    # a first limit for each query from some whole distances
    first = 2 - 2 * rotated_queries @ rotated[:_FIRST].T
    first[own[:, :_FIRST]] = np.inf
    limit = np.sort(first, axis=1)[:, k - 1] if first.shape[1] >= k else np.full(len(queries), np.inf)
    limit = np.maximum(limit, 0)
    alive, part = ~own, np.zeros(own.shape)
    row = col = near = None
    for a in range(0, d, COLUMNS):
        b = min(d, a + COLUMNS)
        q, v = rotated_queries[:, a:b], rotated[:, a:b]
        bound = limit * (b / d) * (1 + epsilon / np.sqrt(b)) ** 2 if b < d else limit
        if row is None:
            # most candidates are in the race: their block of columns is one product
            part += (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v.T
            # reject the hypothesis that the whole distance is within the limit
            alive &= part <= bound[:, None] + 1e-9
            if b == d or alive.mean() < _FEW:
                row, col = np.nonzero(alive)
                near = part[row, col]
        else:
            near += ((q[row] - v[col]) ** 2).sum(axis=1)
            go = near <= bound[row] + 1e-9
            row, col, near = row[go], col[go], near[go]
    m, q = vectors[col], queries[row]
    score = (m * q).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(score)) - np.repeat(begin, np.diff(np.append(begin, len(score))))
    return row[place < k], col[place < k], score[place < k]


def nearest(vectors: DataFrame, queries: DataFrame | Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, probes: int | None = None, recall: float = RECALL, lists: int | None = None, cells: int = LISTS, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query.

    ``queries``: which rows of ``vectors`` ask, or another table with the same columns. ``lists`` beyond ``cells`` are on a second level.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    within = isinstance(queries, Column)
    base = usable(vectors, vec_id, vector, None, F.coalesce(queries, F.lit(False)).alias("asks") if within else F.lit(False).alias("asks"))
    n = base.count()
    if not n:
        return spark.createDataFrame([], schema)
    head = base.select(F.size("v")).first()[0]
    rows = max(1, min(sample, SAMPLE_NUMBERS // head))
    lists = lists or int(max(1, min(MOST_LISTS, np.sqrt(n) / 2)))
    by_hash = base.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v"))
    fitted = _unit(_matrix(by_hash.limit(rows).select("v").toArrow().column(0)))
    centroids = fit_centroids(fitted, max(1, min(lists, cells, len(fitted) // 10)), seed)
    members = _unit(_matrix(by_hash.limit(min(lists, MOST_LISTS, SAMPLE_NUMBERS // head)).select("v").toArrow().column(0))) if lists > cells else None
    index = Lists(centroids, members)
    probes = probes or probes_for(fitted, index, k, recall)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((head, head)))[0]
    model = spark.sparkContext.broadcast((index, turn))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = model.value[0].of(_unit(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "list"])

    kind = base.schema["v"].dataType.simpleString()
    dealt = cut(base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(deal, f"vec_id long, v {kind}, asks boolean, row long, list int"))
    sizes = {r[0]: r[1] for r in dealt.groupBy("list").count().collect()}  # MOST_LISTS rows at most
    filled = spark.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(len(index.lists))]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(_unit(_matrix(batch.column(1))) @ model.value[0].lists.T), axis=1, kind="stable")
            held = filled.value[order]
            order_no = np.cumsum(held > 0, axis=1)
            before = np.cumsum(held, axis=1) - held
            take = (held > 0) & ((order_no <= probes) | (before <= k))  # more lists while these have too few
            row, col = np.nonzero(take)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array(order[row, col].astype(np.int32))], [*batch.schema.names, "list"])

    asked = dealt.where("asks").select("vec_id", "v", "row") if within else usable(queries, vec_id, vector, head).withColumn("row", F.monotonically_increasing_id())
    wanted = cut(asked.mapInArrow(probe, f"vec_id long, v {kind}, row long, list int"))
    asked_sizes = {r[0]: r[1] for r in wanted.groupBy("list").count().collect()}
    chunks = spark.createDataFrame([(i, -(-sizes.get(i, 0) // VECTORS), -(-asked_sizes.get(i, 0) // QUERIES)) for i in range(len(index.lists))], "list int, vs int, qs int").where("vs > 0 and qs > 0")
    chunks = F.broadcast(chunks)
    columns = ["vec_id", "v", "row"]
    left = dealt.join(chunks, "list").select("list", F.pmod(F.xxhash64("row"), "vs").cast("int").alias("vc"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qc"), *columns)
    right = wanted.join(chunks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vc"), F.pmod(F.xxhash64("row"), "qs").cast("int").alias("qc"), *columns)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and b.num_rows:
            m, ids, vector_rows = _matrix(a.column("v")), np.asarray(a.column("vec_id")), np.asarray(a.column("row"))
            q, query_ids, query_rows = _matrix(b.column("v")), np.asarray(b.column("vec_id")), np.asarray(b.column("row"))
            rm, rq = _unit(m) @ model.value[1], _unit(q) @ model.value[1]
            m, q = _scaled(m), _scaled(q)
            for i in range(0, len(q), _BATCH):
                j = slice(i, i + _BATCH)
                own = vector_rows[None, :] == query_rows[j, None] if within else ids[None, :] == query_ids[j, None]
                row, col, score = scan(m, own, q[j], rm, rq[j], ids, k)
                out.append((query_ids[j][row], query_rows[j][row], ids[col], vector_rows[col], score))
        names = ("query_id", "query_row", "vec_id", "row", "score")
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pa.table(dict(zip(names, cols, strict=True)))

    keys = ["list", "vc", "qc"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, query_row long, vec_id long, row long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_row order by score desc, vec_id, row)")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
