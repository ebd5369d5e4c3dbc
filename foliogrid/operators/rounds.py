"""Rounds of a batch as jobs over tables: what is queued, taken within a budget, done, and handed to the next round.

State has doc_hash, scan_round, target_type, target_id, page_num, status, priority, input_hash, error, attempts: one row for each job. Every step is a
join or a grouped choice by the job's key, so a round over all documents is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_hash", "scan_round", "target_type", "target_id"]
STATE = [*KEY, "page_num", "status", "priority", "input_hash", "error", "attempts"]
ERROR = 500


def _merged(state: DataFrame, new: DataFrame, keeps: Column) -> DataFrame:
    """The state with jobs queued anew but where ``keeps`` holds (it sees new_* columns); ``inserted`` tells which were queued."""
    other = new.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("page_num", "priority", "input_hash")], F.lit(True).alias("__new"))
    both = state.join(other, KEY, "full_outer")
    stays = F.col("__new").isNull() | F.coalesce(keeps, F.lit(False))
    take = lambda c, other: F.when(stays, F.col(c)).otherwise(other).alias(c)
    return both.select(
        *KEY,
        F.coalesce("page_num", "new_page_num").alias("page_num"),
        take("status", F.lit("queued")),
        F.greatest("priority", "new_priority").alias("priority"),
        take("input_hash", F.coalesce("new_input_hash", "input_hash")),
        F.when(F.col("__new").isNull(), F.col("error")).otherwise(F.when(F.coalesce(keeps, F.lit(False)), F.coalesce("error", F.lit(""))).otherwise("")).alias("error"),
        F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"),
        (~stays).alias("inserted"),
    )


def enqueue_pages(state: DataFrame, pages: DataFrame, scan_round: str) -> DataFrame:
    """Page jobs (doc_hash, page_num, priority) merged into the state: each page once, negative ones ignored, done ones stay done."""
    wanted = pages.where("page_num >= 0").groupBy("doc_hash", "page_num").agg(F.max("priority").alias("priority"))
    new = wanted.select("doc_hash", F.lit(scan_round).alias("scan_round"), F.lit("page").alias("target_type"), F.col("page_num").cast("string").alias("target_id"), "page_num", "priority", F.lit(None).cast("string").alias("input_hash"))
    return _merged(state, new, F.col("status") == "done")


def enqueue_records(state: DataFrame, records: DataFrame, scan_round: str, target_type: str = "block") -> DataFrame:
    """Round records (doc_hash, target_id, page_num, priority, input_hash) merged into the state: done ones with the same input, or without any, stay done."""
    best = F.max_by(F.struct("page_num", "input_hash"), F.struct("priority", "input_hash"))
    wanted = records.where("page_num >= 0").groupBy("doc_hash", "target_id").agg(F.max("priority").alias("priority"), best.alias("b"))
    new = wanted.select("doc_hash", F.lit(scan_round).alias("scan_round"), F.lit(target_type).alias("target_type"), "target_id", F.col("b.page_num").alias("page_num"), "priority", F.col("b.input_hash").alias("input_hash"))
    return _merged(state, new, (F.col("status") == "done") & (F.col("new_input_hash").isNull() | F.col("input_hash").eqNullSafe(F.col("new_input_hash"))))


def taken(state: DataFrame, scan_round: str, budget: int) -> DataFrame:
    """The next ``budget`` queued jobs of each document in a round."""
    queued = state.where((F.col("scan_round") == scan_round) & (F.col("status") == "queued"))
    place = F.expr("row_number() over (partition by doc_hash order by priority desc, page_num, target_id)")
    return queued.withColumn("__place", place).where(F.col("__place") <= max(budget, 0)).select(*STATE)


def settled(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The state after outcomes (key, outcome, reason): each was running once, its error is cut at ``ERROR`` characters."""
    both = state.select(*STATE).join(outcomes.select(*KEY, "outcome", "reason"), KEY, "left")
    return both.select(*KEY, "page_num", F.coalesce("outcome", "status").alias("status"), "priority", "input_hash", F.when(F.col("outcome").isNull(), F.col("error")).otherwise(F.left(F.coalesce("reason", F.lit("")), F.lit(ERROR))).alias("error"), (F.col("attempts") + F.when(F.col("outcome").isNull(), 0).otherwise(1)).alias("attempts"))


def graph_batch(state: DataFrame, blocks: DataFrame, facts: DataFrame, budget: int, scan_round: str = "knowledge_graph") -> DataFrame:
    """The state after one batch of graph extraction: blocks (doc_hash, target_id) that may state facts, facts (doc_hash, target_id, n) that they do.

    A job whose block is gone, or that states nothing, is skipped with the reason.
    """
    jobs = taken(state, scan_round, budget)
    there = blocks.select("doc_hash", "target_id", F.lit(True).alias("there")).distinct()
    stated = facts.groupBy("doc_hash", "target_id").agg(F.sum("n").alias("facts"))
    seen = jobs.join(there, ["doc_hash", "target_id"], "left").join(stated, ["doc_hash", "target_id"], "left")
    reason = F.when(F.col("there").isNull(), "block_not_available").when(F.coalesce("facts", F.lit(0)) == 0, "no_structural_graph_facts").otherwise("")
    return settled(state, seen.select(*KEY, F.when(reason == "", "done").otherwise("skipped").alias("outcome"), reason.alias("reason")))


def update_batch(state: DataFrame, blocks: DataFrame, accepted: DataFrame, indexed: DataFrame, budget: int, scan_round: str = "knowledge_incremental_update") -> tuple[DataFrame, DataFrame]:
    """(state, upserts) after one batch of index updates.

    Blocks are (doc_hash, target_id, block_type, content), accepted results (doc_hash, target_id, latex), indexed the documents with an index (doc_hash). Jobs of documents
    without an index wait. An accepted result replaces its block's content, or stands in for a block that is gone; other jobs without a formula block are skipped.
    upserts: doc_hash, target_id, content, graph_synced.
    """
    jobs = taken(state.join(indexed.select("doc_hash").distinct(), "doc_hash", "left_semi"), scan_round, budget)
    found = jobs.join(blocks.select("doc_hash", "target_id", "block_type", "content"), ["doc_hash", "target_id"], "left").join(accepted.select("doc_hash", "target_id", F.trim("latex").alias("latex")).where("latex <> ''"), ["doc_hash", "target_id"], "left")
    fits = (F.col("block_type") == "formula") | (F.col("block_type").isNull() & F.col("latex").isNotNull())
    marked = found.withColumn("fits", F.coalesce(fits, F.lit(False)))
    outcome = marked.select(*KEY, F.when(F.col("fits"), "done").otherwise("skipped").alias("outcome"), F.when(F.col("fits"), "").otherwise("missing_formula_block").alias("reason"))
    upserts = marked.where("fits").select("doc_hash", "target_id", F.coalesce("latex", "content").alias("content"), F.col("latex").isNotNull().alias("graph_synced"))
    return settled(state, outcome), upserts


def counts(state: DataFrame) -> DataFrame:
    return state.groupBy("scan_round", "status").agg(F.count("*").alias("n"))
