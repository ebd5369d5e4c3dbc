"""Streams: job state and blocks kept up to date as events and documents arrive.

Batch and stream share their transformations, so a stream that has seen all files holds what the batch plan
gives. State tables are written as versions; the newest one counts, and a batch that runs again after a failure
writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliogrid.plans.base import blocks_of
from foliogrid.plans.queue import KEY, job_events


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a state table; None before the first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(s.getPath().getName()[8:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/version={max(done)}") if done else None


def _before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    for version in range(batch - 1, -1, -1):
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/_SUCCESS")
        if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            return spark.read.parquet(f"{path}/version={version}")
    return None


def summaries(events: DataFrame) -> DataFrame:
    """What merges: the last event of each job, its sums and extremes."""
    return job_events(events).groupBy(*KEY).agg(F.expr("max(struct(event_id, status, content_hash, error))").alias("last"), F.max("priority").alias("priority"), F.expr("count_if(status = 'running')").alias("attempts"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy(*KEY).agg(F.max("last").alias("last"), F.max("priority").alias("priority"), F.sum("attempts").alias("attempts"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def state_of(table: DataFrame) -> DataFrame:
    return table.select(*KEY, "last.status", "last.content_hash", "priority", "last.error", "attempts", "created_at", "updated_at")


def keep_job_state(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Maintain job state from a stream of events: each batch is summed up and merged into the table."""

    def merge(batch: DataFrame, number: int) -> None:
        new = summaries(batch)
        old = _before(batch.sparkSession, path, number)
        (new if old is None else merged(old, new)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_blocks(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Blocks of arriving documents, appended exactly once."""
    return blocks_of(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark, which wants a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def first_requests(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each user's request of a kind once within the delay: duplicates in flight are dropped."""
    return timed(events, delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by kind and window. An extra: the operators above have no event time."""
    return timed(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def current_results(results: DataFrame, requests: DataFrame, key: str = "key") -> DataFrame:
    """Results (key, version, ...) that still answer the newest request (key, version) of their key; late and cancelled ones are dropped.

    Versions are compared, not times. ``requests`` is a table; ``results`` may be a stream: its batches meet the table as it is when they run.
    """
    newest = requests.groupBy(F.col(key).alias("__key")).agg(F.max("version").alias("__version"))
    return results.join(newest, (F.col(key) == F.col("__key")) & (F.col("version") == F.col("__version")), "left_semi")


def keep_current(results: DataFrame, requests_path: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's current results to a table; each batch reads the requests anew."""

    def keep(batch: DataFrame, number: int) -> None:
        current_results(batch, batch.sparkSession.read.parquet(requests_path)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
