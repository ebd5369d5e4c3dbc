"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / w: u from a hash of its id, w its quality weight. Sorted by
key within its source, documents fill the source's word budget by prefix sums. A budget
beyond the source's size takes complete epochs first and selects the rest by key.

Prefix sums are two-level: documents are range-partitioned by (source, key), each partition sums
its own, and totals of partitions give the offsets. A source with a third of all rows spans many partitions.

Defined results: size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null; a null source is a source
like any other, last in order; rows with equal ids have equal keys and are ordered by size; rows of size
0 are taken with 0 words; a document at the edge of a budget is taken if at least half of it is
inside, so a source misses its target by half a document at most; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliogrid.session import cut, small

SOURCE_WEIGHTS = (3, 1, 2)
BUDGET_PERCENT, MAX_EPOCHS = 150, 2
SIZE = "cast(coalesce(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) as long)"


def unit(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, percent: float = BUDGET_PERCENT, epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Shares of ``percent`` of all sizes by weight; a target stops at ``epochs`` times its source's size and what is
    over goes to the others by weight, until none is above. In order of cap / weight the
    sources at their cap come first, so the level of the others follows from running sums.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select("source", "source_size", F.expr("row_number() over (order by source asc nulls last) - 1").alias("place"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(epochs))
    ranked = ranked.withColumn("whole", F.expr("sum(source_size) over ()") * (percent / 100))
    order = "order by cap / weight, place"
    ranked = ranked.withColumn("level", F.expr(f"(whole - (sum(cap) over ({order} rows unbounded preceding) - cap)) / (sum(weight) over (order by cap / weight desc, place desc rows unbounded preceding))"))
    ranked = ranked.withColumn("full", F.expr("cap <= level * weight"))
    ranked = ranked.withColumn("rest", F.expr("(whole - sum(case when full then cap else 0 end) over ()) / (sum(case when full then 0 else weight end) over ())"))
    return ranked.select("source", "source_size", F.expr("case when full then cap else least(cap, rest * weight) end").alias("target"))


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the running sum of sizes before each row in its partition and source."""
    part, held, source = TaskContext.get().partitionId(), 0, object()
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(1).dictionary_encode()
        code = np.asarray(codes.indices.fill_null(-1))
        sizes = np.asarray(batch.column(2))
        total = np.cumsum(sizes)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
        base = np.repeat(np.where(cuts > 0, total[cuts - 1], 0), np.diff(np.concatenate([cuts, [len(code)]])))
        before = total - sizes - base
        if batch.column(1)[0].as_py() == source:
            n = cuts[1] if len(cuts) > 1 else len(code)
            before[:n] += held
        source, held = batch.column(1)[-1].as_py(), int(before[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(code), part, np.int32))], [*batch.schema.names, "before", "part"])


def mix(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", source_weights: Sequence[float] = SOURCE_WEIGHTS, percent: float = BUDGET_PERCENT, epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words), times (copies).

    ``weights`` has (doc_id, weight) with weight > 0; documents without one weigh 1.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    slim = slim.select("doc_id", "source", F.expr(SIZE).alias("size"))
    if weights is None:
        keyed = slim.withColumn("weight", F.lit(1.0))
    else:
        own = weights.where("weight > 0").groupBy(F.col("doc_id").alias("__w")).agg(F.avg("weight").alias("weight"))
        keyed = slim.join(own, F.col("doc_id") == F.col("__w"), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    keyed = cut(keyed.select("doc_id", "source", "size", (-F.log(unit(F.col("doc_id"))) / F.col("weight")).alias("key")))
    order = ["source", "key", "doc_id", "size"]
    kind = docs.schema[doc_id].dataType.simpleString()
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_before, f"doc_id {kind}, source string, size long, key double, before long, part int")
    placed = cut(placed.drop("key"))
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    offsets = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.expr("sum(sum) over (partition by source order by part) - sum").alias("offset"))
    goals = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), source_weights, percent, epochs)
    goals = offsets.join(goals.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g")))
    out = placed.join(small(goals), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    whole = F.expr("case when source_size > 0 then floor(target / source_size) else 0 end")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    inside = F.col("before") + F.col("offset") + F.col("size") / 2 <= rest
    out = out.withColumn("whole", whole).withColumn("times", (F.col("whole") + F.when((F.col("size") > 0) & inside, 1).otherwise(0)).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns, so that its words are the mix's.

    Rows of one id, source and size share a place in the source's order and are taken alike, but where the source's budget ends among
    them: then some are taken once more, whichever. Documents without words take part once where their source is taken whole.
    """
    text, source = options.get("text", "text"), options.get("source", "source")
    place = ["__id", "__source", "__size"]
    mixed = mix(docs, weights, doc_id, **options).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "times")
    times = cut(mixed.groupBy(*place).agg(F.sum("times").alias("__sum"), F.count("*").alias("__rows")).where("__sum > 0"))
    times = times.withColumn("__times", F.expr("cast(__sum div __rows as int)")).withColumn("__more", F.expr("__sum % __rows")).drop("__sum", "__rows")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & F.col(source).cast("string").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__size"))
    sized = docs.withColumn("__own", F.expr(SIZE.replace("(text,", f"(`{text}`,")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = sized.join(times.where("__more = 0"), same).withColumn("__copies", F.col("__times")).select(*columns, "__copies")
    # a budget ends among equals at most once in a source, and seldom: a row of `split` for each source at most
    split = times.where("__more > 0")
    if split.count():
        split = split.withColumn("__n", F.expr("row_number() over (order by __source, __id, __size)"))
        # numbered by the task that reads them and a running number there, so that no task has all equals
        some = cut(sized.join(F.broadcast(split), same).withColumn("__task", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
        counts = some.groupBy("__n", "__task").agg(F.count("*").alias("__here"))
        counts = counts.select(F.col("__n").alias("__m"), F.col("__task").alias("__t"), F.expr("sum(__here) over (partition by __n order by __task) - __here").alias("__before"))
        some = some.withColumn("__number", F.expr("row_number() over (partition by __n, __task order by __row)"))
        some = some.join(F.broadcast(counts), (F.col("__n") == F.col("__m")) & (F.col("__task") == F.col("__t")))
        some = some.withColumn("__copies", F.col("__times") + F.when(F.col("__before") + F.col("__number") <= F.col("__more"), 1).otherwise(0))
        taken = taken.unionByName(some.where("__copies > 0").select(*columns, "__copies"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels: good documents weigh 2, poor ones 0.5."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))
