"""N-gram Jaccard join: a size-aware heavy-light join over the word n-gram sets of documents.

Sets are ordered by one total order: n-grams that many documents share come last (by how many, as far
as tasks have seen them more than once), before them longer n-grams come first, ties by hash. If two
sets of Jaccard >= t link, each shares at least a = ceil(t * size) elements, so their prefixes of
size - a + k elements share k elements at least.

* Light sets, of at most ``boundary`` elements, enumerate the 2-subsets of their (size - a + 2)-prefix; two light sets
  are compared only if they share such a subset.
* Heavy sets put the (size - a + 1)-prefix into inverted lists, and so do light sets large enough to link with
  one; lists are scanned for partners.
* The boundary is the size at which enumerating subsets below it plus scanning lists above it costs least,
  from the histogram of sizes and the list entries that sets of each size share with others.

Equal sets are one class before any join. A list is never turned into all its pairs: in each round its
first members (1, then 16, 256, ...) are compared with the others and leave it, and a list whose
members are all connected is done. Every pair is thus either compared exactly or known to be in one
component; pairs whose sizes and places in the list rule out a link are skipped. Comparison is an exact intersection of whole sets.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text with fewer words
than n is one n-gram; null, empty and blank texts have empty sets, link with nothing and are
components of their own; equal rows link; rows with a null id take part, and a component's id
is its least id that isn't null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.llm import _text as T
from foliogrid.operators.components import connected_components
from foliogrid.session import cut, small

N, PERCENT = 3, 90
#: Frequent n-grams that are ordered by frequency and broadcast (16 bytes each); any others are ordered by length.
FREQUENT = 250_000
#: What a pair to compare costs, in list entries or enumerated subsets: it is shuffled twice with prefixes.
PAIR = 10
#: Bits of a set's parities.
MARKS = 2048
#: Pairs that one task compares, or so: few pairs need few tasks, each of which writes a file for each shuffle.
PAIRS_A_TASK, ENTRIES_A_TASK = 2_000, 50_000


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """First row, and for each row its distinct n-gram hashes, ascending, and their bytes."""
    for i, j, data, offsets in T.text_steps(column):
        w = T.split_words(data, offsets, T.SPACED)
        g, size = T.grams(w.hashes, n), w.ends - w.starts
        length = sum(size[k : k + len(g)] for k in range(n)) if len(g) else size[:0]
        out = []
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= n:
                h, at = np.unique(g[a : b - n + 1], return_index=True)
                out.append((h, length[a : b - n + 1][at]))
            elif b > a:
                out.append((T.grams(w.hashes[a:b], b - a), np.array([size[a:b].sum()])))
            else:
                out.append((g[:0], size[:0]))
        yield i, out


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        x = T.mix(h ^ T.U(0x5851F42D4C957F2D))
        return int(np.add.reduce(x).view(np.int64)), int((np.bitwise_xor.reduce(T.mix(x + h)) if len(h) else T.U(0)).view(np.int64))


def _frequent(texts: DataFrame, n: int, most: int) -> DataFrame:
    """(gram, docs): n-grams that tasks have met in several texts, the ``most`` most frequent or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def shared() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(T.as_long(g[c > 2])), pa.array(c[c > 2])], ["gram", "docs"])

        for batch in batches:
            for _, sets in _sets(batch.column(0), n):
                held += [h for h, _ in sets if len(h)]
                if sum(map(len, held)) > 1_000_000:
                    yield shared()
        if held:
            yield shared()

    counts = cut(T.mapped(texts, run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")))
    # the least count that leaves no more than `most`, from a histogram by powers of 2^(1/4)
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("docs") * 4)).count().collect()), reverse=True)
    kept, floor = 0, None
    for level, count in levels:
        if kept + count > most:
            break
        kept, floor = kept + count, level
    return counts.where(F.floor(F.log2("docs") * 4) >= F.lit(floor)) if floor is not None else counts.where("false")


def _prefixes(docs: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """(doc_id, h1, h2, size, grams): the digest of each document's set, and its prefix in the total order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        for batch in batches:
            for i, sets in _sets(batch.column(1), n):
                grams = np.concatenate([h for h, _ in sets])
                lengths = np.concatenate([x for _, x in sets])
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    rank = np.where(keys[at] == grams, counts[at] + (1 << 40), -lengths)
                else:
                    rank = -lengths
                first, digests, prefix, sizes = 0, [], [], []
                for h, _ in sets:
                    m = len(h)
                    p = min(m, m + (-percent * m // 100) + 2)  # size - ceil(t size) + 2
                    r = rank[first : first + m]
                    if p < m:
                        some = np.flatnonzero(r <= np.partition(r, p - 1)[p - 1])
                        order = some[np.lexsort((h[some], r[some]))][:p]
                    else:
                        order = np.lexsort((h, r))
                    prefix.append(h[order])
                    digests.append(_digest(h))
                    sizes.append(m)
                    first += m
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(sets)), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(sizes, pa.int32()), T.list_array(pa.array(T.as_long(np.concatenate(prefix))), ends)],
                    ["doc_id", "h1", "h2", "size", "grams"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return T.mapped(docs, run, f"doc_id {kind}, h1 long, h2 long, size int, grams array<long>")


def _parities(h: np.ndarray) -> np.ndarray:
    """For each of ``MARKS`` classes of hashes whether the set has an odd number of them, as bits of longs: two sets differ in as many elements at least as bits."""
    odd = np.bincount((h & T.U(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _whole_sets(texts: DataFrame, n: int) -> DataFrame:
    """(h1, h2, grams, marks) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column(0), n):
                digests = [_digest(h) for h, _ in sets]
                ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in sets])])
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), T.list_array(pa.array(T.as_long(np.concatenate([h for h, _ in sets]))), ends), T.list_array(pa.array(np.concatenate([_parities(h) for h, _ in sets])), np.arange(len(sets) + 1) * (MARKS // 64))], ["h1", "h2", "grams", "marks"])

    return T.mapped(texts, run, "h1 long, h2 long, grams array<long>, marks array<long>")


def choose_boundary(histogram: list[tuple[int, int, float]], percent: int) -> int:
    """The size up to which sets enumerate subsets, from (size, sets, list entries of such a set that others share).

    A heavy set costs its prefix's entries, and ``PAIR`` for each that others share, as it is compared with what leads that list.
    A light set costs its subsets, and ``PAIR`` for those made of two entries that others share.
    """
    best, least = 0, math.inf
    largest = max((size for size, _, _ in histogram), default=0)
    for bound in [0, *sorted({size for size, _, _ in histogram})]:
        cost = 0.0
        for size, sets, shared in histogram:
            p = size - -(-percent * size // 100) + 1
            if size <= bound:
                cost += sets * (math.comb(min(p + 1, size), 2) + PAIR * shared * shared / 2)
            if size > bound or 100 * size >= percent * (bound + 1) and bound < largest:
                cost += sets * (p + PAIR * shared)
        if cost < least:
            best, least = bound, cost
    return best


def _links(pairs: DataFrame, prefix: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) of pairs (node, pivot) whose sets have Jaccard >= percent / 100.

    What two sets share is in both prefixes or behind the one that ends first, so c shared elements of the
    prefixes bound the intersection by c + the longer rest. Pairs that pass are held against the sets' parities, 256 bytes each,
    which bound from below how much two sets differ. Only pairs that pass again fetch whole sets.
    """
    asked = small(pairs.select(F.explode(F.array("node", "pivot")).alias("node")).distinct())
    parts = pairs.count() // PAIRS_A_TASK + 1
    # all tasks look for what few pairs ask for; only what they find goes to few tasks
    own = prefix.join(asked, "node", "left_semi").select("node", "size", "p", F.slice("grams", F.lit(1), F.col("p")).alias("grams")).repartition(parts)
    other = own.select(*[F.col(c).alias(f"pivot_{c}" if c != "node" else "pivot") for c in own.columns])
    near = pairs.join(own, "node").join(other, "pivot").withColumn("both", F.size(F.array_intersect("grams", "pivot_grams")))
    near = near.where(F.expr(f"(both + greatest(size - p, pivot_size - pivot_p)) * {100 + percent} >= {percent} * (size + pivot_size)"))
    near = cut(near.select("node", "pivot").coalesce(parts))
    involved = small(near.select(F.explode(F.array("node", "pivot")).alias("node")).distinct())
    involved = cut(classes.join(involved, "node", "left_semi").select("node", "h1", "h2", "least").repartition(parts))
    wanted = small(involved.select(F.col("least").alias("wanted")).distinct())
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    known = _whole_sets(texts.select("text"), n)
    sets = cut(known.join(small(involved.select("h1", "h2", "node")), ["h1", "h2"]).select("node", "grams", "marks"))
    if sets.count() > involved.count():  # rows that repeat an id, or have none, hold a set again
        sets = cut(sets.groupBy("node").agg(F.first("grams").alias("grams"), F.first("marks").alias("marks")).coalesce(parts))
    marks = sets.select("node", F.size("grams").alias("size"), "marks")
    differ = F.expr("aggregate(zip_with(marks, pivot_marks, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)")
    met = marks.join(small(near), "node").join(marks.select(*[F.col(c).alias(f"pivot_{c}" if c != "node" else "pivot") for c in marks.columns]), "pivot")
    near = cut(met.where(differ * (100 + percent) <= (100 - percent) * (F.col("size") + F.col("pivot_size"))).select("node", "pivot").coalesce(parts))
    # whole sets are what a shuffle here is made of: each side takes those that it looks for
    side = lambda c: sets.select("node", "grams").join(small(near.select(F.col(c).alias("node")).distinct()), "node", "left_semi")
    other = side("pivot").select(F.col("node").alias("pivot"), F.col("grams").alias("pivot_grams"))
    compared = side("node").join(small(near), "node").join(other, "pivot").withColumn("both", F.size(F.array_intersect("grams", "pivot_grams")))
    return compared.where(F.expr(f"100 * both >= {percent} * (size(grams) + size(pivot_grams) - both)")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each document."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    often = _frequent(slim.select("text"), n, frequent).toArrow()  # `frequent` rows at most
    keys, counts = np.asarray(often.column(0)).view(T.U), np.asarray(often.column(1))
    order = np.argsort(keys)
    ranked = spark.sparkContext.broadcast((keys[order], counts[order]))

    each = cut(_prefixes(slim, n, percent, ranked))
    classes = each.where("size > 0").groupBy("h1", "h2").agg(F.first("size").alias("size"), F.first("grams").alias("grams"), F.min("doc_id").alias("least"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    # sizes at which two different sets can link: with one element more, or one less
    prefix = classes.where(F.expr(f"size * 100 >= {percent} * (size + 1) or size * {percent} <= 100 * (size - 1)")).withColumn("p", F.expr(f"cast(size - (size * {percent} + 99) div 100 + 1 as int)"))

    # an entry's place bounds the size of a partner that it can still link with
    reach = F.expr(f"cast(({100 + percent} * (size - pos)) div {percent} - size as int)")
    entries = prefix.select("node", "size", F.posexplode(F.slice("grams", F.lit(1), F.col("p"))).alias("pos", "key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("entries"), F.min("size").alias("smallest")).where("entries > 1")
    # most entries stand alone in their list: until that is known, size and place go as one number, and what follows from them doesn't
    packed = entries.select("key", "node", F.expr("shiftleft(cast(size as long), 32) | cast(pos as long)").alias("place")).join(lists, "key")
    unpacked = packed.select("key", "node", F.expr("cast(shiftright(place, 32) as int)").alias("size"), F.expr("cast(place & 4294967295 as int)").alias("pos"), "smallest")
    shared = cut(unpacked.withColumn("reach", reach).where("reach >= smallest").drop("smallest"))
    kept = shared.groupBy("size").agg(F.count("*").alias("kept"))
    histogram = [(r[0], r[1], (r[2] or 0) / r[1]) for r in prefix.groupBy("size").count().join(kept, "size", "left").collect()]  # by size: bounded by the longest text
    boundary = choose_boundary(_coarse(histogram), percent)

    heavy = any(size > boundary for size, _, _ in histogram)
    scanned = shared.where(F.expr(f"100 * size >= {percent} * ({boundary} + 1)") if heavy else F.lit(False)).select("key", "node", "size", "pos", "reach")
    pairs_of = F.expr("flatten(transform(slice(grams, 1, p + 1), (x, i) -> transform(slice(grams, i + 2, greatest(p - i, 0)), y -> xxhash64(x, y))))")
    subsets = prefix.where(F.col("size") <= boundary).select(F.explode(pairs_of).alias("key"), "node", "size", F.lit(0).alias("pos"), F.expr(f"cast(size * 100 div {percent} as int)").alias("reach"))
    twice = subsets.groupBy("key").count().where("count > 1").select("key")
    members = cut(scanned.unionByName(subsets.join(twice, "key")))

    label = None
    width = 1
    entries_left = members.count()
    while True:
        if label is None:
            live = members.withColumn("label", F.col("node"))
        else:
            live = members.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        split = live.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        live = cut(live.join(split, "key").coalesce(entries_left // ENTRIES_A_TASK + 1))
        entries_left = live.count()
        if not entries_left:
            break
        # those whose n-grams are shared most widely come first: the midst of a family of near copies
        first = live.withColumn("rank", F.expr("row_number() over (partition by key order by pos, node)"))
        pivots = first.where(F.col("rank") <= width).select("key", *[F.col(c).alias(p) for c, p in (("node", "pivot"), ("pos", "pivot_pos"), ("size", "pivot_size"), ("reach", "pivot_reach"), ("label", "pivot_label"))])
        later = F.expr("struct(pos, node) > struct(pivot_pos, pivot)")
        pairs = live.join(pivots, "key").where(later).where("label <> pivot_label and size <= pivot_reach and pivot_size <= reach").select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot")).distinct()
        pairs = cut(pairs.coalesce(entries_left // ENTRIES_A_TASK + 1))
        links = _links(pairs, prefix, classes, slim, n, percent)
        if label is None:
            edges = links
        else:  # old components stay connected
            edges = links.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
        label = cut(connected_components(edges))
        members = live.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti").select("key", "node", "size", "pos", "reach")
        width *= 16

    ids = classes.select("h1", "h2", "node", "least")
    if label is not None:
        ids = ids.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        ids = ids.withColumn("component", F.col("node"))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ids.join(least, "component").select("h1", "h2", "component_id")
    return each.join(ids, ["h1", "h2"], "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _coarse(histogram: list[tuple[int, int, float]], most: int = 400) -> list[tuple[int, int, float]]:
    """The histogram in no more than ``most`` classes of size, each under its largest."""
    histogram = sorted(histogram)
    step = -(-len(histogram) // most) or 1
    out = []
    for i in range(0, len(histogram), step):
        part = histogram[i : i + step]
        sets = sum(x[1] for x in part)
        out.append((part[-1][0], sets, sum(x[1] * x[2] for x in part) / sets))
    return out


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each component, with all columns: the one of the least id.

    Rows that repeat its id and text go as well. Documents without n-grams are components of their
    own and stay, as do rows with a null id.
    """
    text = options.get("text", "text")
    ids = jaccard_components(docs, doc_id, **options).where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("__keep")).distinct()
    kept = docs.join(small(ids), F.col(f"`{doc_id}`") == F.col("__keep"), "left_semi")
    repeated = small(docs.groupBy(F.col(f"`{doc_id}`").alias("__twice")).count().where("count > 1 and __twice is not null").select("__twice"))
    single = kept.join(repeated, F.col(f"`{doc_id}`") == F.col("__twice"), "left_anti")
    double = kept.join(repeated, F.col(f"`{doc_id}`") == F.col("__twice"), "left_semi").dropDuplicates([doc_id, text])
    return single.unionByName(double).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
