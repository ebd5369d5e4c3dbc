from pyspark.sql import functions as F

from foliogrid.plans.base import blocks_of
from foliogrid.plans.queue import job_events, job_state
from foliogrid.streaming import jobs as J

PATH = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{PATH}/events.parquet")
    for i in range(4):
        events.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = J.event_stream(spark, f"{tmp_path}/in", events.schema)
    J.keep_job_state(stream, f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    got = sorted(map(tuple, J.state_of(J.read_state(spark, f"{tmp_path}/state")).collect()))
    assert got == sorted(map(tuple, job_state(job_events(events)).collect()))
    # more events arrive; the stream goes on where it was
    events.where("event_id < 50").withColumn("event_id", F.col("event_id") + 5000).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    J.keep_job_state(J.event_stream(spark, f"{tmp_path}/in", events.schema), f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    every = spark.read.parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, J.state_of(J.read_state(spark, f"{tmp_path}/state")).collect())) == sorted(map(tuple, job_state(job_events(every)).collect()))
    assert J.read_state(spark, f"{tmp_path}/none") is None


def test_blocks_of_arriving_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    J.keep_blocks(J.event_stream(spark, f"{tmp_path}/in", docs.schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, blocks_of(docs).collect()))


def test_windows_and_duplicates(spark, tmp_path):
    events = spark.read.parquet(f"{PATH}/events.parquet")
    assert J.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
    events.write.parquet(f"{tmp_path}/in")
    stream = J.event_stream(spark, f"{tmp_path}/in", events.schema, 100)
    q = J.first_requests(stream, "60 days").writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == events.select("user_id", "event_type").distinct().count()
