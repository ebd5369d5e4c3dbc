"""Jobs by rounds: pages and records queued, graph and update batches, and the rounds of recognition one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.operators import rounds as R
from foliogrid.plans.base import BLOCKS, FORMULAS, blocks, formulas, query
from foliogrid.plans.fusion import fusion_rows, fusion_sql
from foliogrid.plans.graph import _FACTS
from foliogrid.session import cut, table

_STATUS = "case event_type when 'click' then 'queued' when 'view' then 'running' when 'purchase' then 'done' when 'error' then 'failed' else 'skipped' end"


def _old_jobs(spark, sf_dir, target: str, page: str, kind: str, scan_round: str) -> DataFrame:
    """Jobs that are there: the last of two thirds of the events of a target."""
    e = table(spark, sf_dir, "events").where("event_id % 3 <> 0").selectExpr("concat('d', user_id % 10) as doc_hash", f"{target} as target_id", f"{page} as page_num", f"{_STATUS} as status", "value", "event_id", "concat('h', event_id % 4) as input_hash")
    s = e.groupBy("doc_hash", "target_id").agg(F.expr("max_by(struct(page_num, status, input_hash), event_id)").alias("b"), F.max("value").alias("priority"), F.expr("count_if(status = 'running')").alias("attempts"))
    return s.selectExpr("doc_hash", f"'{scan_round}' as scan_round", f"'{kind}' as target_type", "target_id", "b.page_num as page_num", "b.status as status", "priority", f"{'b.input_hash' if kind == 'block' else 'cast(null as string)'} as input_hash", "if(b.status = 'failed', 'boom', '') as error", "attempts")


def _old_sql(target: str, page: str, hashed: str = "arg_max(input_hash, event_id)") -> str:
    return f"""e as (select 'd' || (user_id % 10) as doc_hash, {target} as target_id, {page} as page_num, {_STATUS} as status, value, event_id, 'h' || (event_id % 4) as input_hash from events where event_id % 3 <> 0),
    old as (select doc_hash, target_id, arg_max(page_num, event_id) as page_num, arg_max(status, event_id) as status, max(value) as priority, {hashed} as input_hash, count(*) filter (where status = 'running') as attempts from e group by all)"""


@query(
    "q02_enqueue_pages",
    f"""with {_old_sql("(user_id % 30)::varchar", "(user_id % 30)::int", "null::varchar")},
    new as (select 'd' || (user_id % 10) as doc_hash, ((event_id % 40)::int - 5)::varchar as target_id, (event_id % 40)::int - 5 as page_num, max(value) as priority from events where event_id % 3 = 0 and event_id % 40 >= 5 group by all)
    select doc_hash, target_id, coalesce(old.page_num, new.page_num) as page_num, case when new.priority is null or old.status = 'done' then old.status else 'queued' end as status, greatest(old.priority, new.priority) as priority,
      case when new.priority is null and old.status = 'failed' then 'boom' else '' end as error, coalesce(attempts, 0) as attempts, new.priority is not null and coalesce(old.status, '') <> 'done' as inserted from old full join new using (doc_hash, target_id)""",
)
def q02(spark, sf_dir):
    """Pages to scan merged into the queue: each once, no negative ones, done ones stay done."""
    old = _old_jobs(spark, sf_dir, "cast(user_id % 30 as string)", "cast(user_id % 30 as int)", "page", "pdf_structure")
    new = table(spark, sf_dir, "events").where("event_id % 3 = 0").selectExpr("concat('d', user_id % 10) as doc_hash", "cast(event_id % 40 as int) - 5 as page_num", "value as priority")
    return R.enqueue_pages(old, new, "pdf_structure").select("doc_hash", "target_id", "page_num", "status", "priority", "error", "attempts", "inserted")


@query(
    "q03_enqueue_records",
    f"""with {_old_sql("'b' || (user_id % 50)", "(user_id % 7)::int")},
    inc as (select 'd' || (user_id % 10) as doc_hash, 'b' || (event_id % 60) as target_id, (event_id % 9)::int - 1 as page_num, value as priority, case when event_id % 5 = 0 then null else 'h' || (event_id % 4) end as input_hash from events where event_id % 3 = 0),
    new as (select doc_hash, target_id, max(priority) as priority, first(page_num order by priority desc, input_hash desc nulls last) as page_num, first(input_hash order by priority desc, input_hash desc nulls last) as input_hash from inc where page_num >= 0 group by all),
    b as (select doc_hash, target_id, old.page_num as op, new.page_num as np, old.status, old.priority as oq, new.priority as nq, old.input_hash as oh, new.input_hash as nh, attempts, new.priority is null or coalesce(old.status = 'done' and (new.input_hash is null or old.input_hash is not distinct from new.input_hash), false) as stays from old full join new using (doc_hash, target_id))
    select doc_hash, target_id, coalesce(op, np) as page_num, case when stays then status else 'queued' end as status, greatest(oq, nq) as priority, case when stays then oh else coalesce(nh, oh) end as input_hash,
      case when nq is null and status = 'failed' then 'boom' else '' end as error, coalesce(attempts, 0) as attempts, not stays as inserted from b""",
)
def q03(spark, sf_dir):
    """Records of a round merged into the queue: done ones with the same input stay done."""
    old = _old_jobs(spark, sf_dir, "concat('b', user_id % 50)", "cast(user_id % 7 as int)", "block", "semantic_review")
    new = table(spark, sf_dir, "events").where("event_id % 3 = 0").selectExpr("concat('d', user_id % 10) as doc_hash", "concat('b', event_id % 60) as target_id", "cast(event_id % 9 as int) - 1 as page_num", "value as priority", "if(event_id % 5 = 0, null, concat('h', event_id % 4)) as input_hash")
    return R.enqueue_records(old, new, "semantic_review").select("doc_hash", "target_id", "page_num", "status", "priority", "input_hash", "error", "attempts", "inserted")


BUDGET = 8
_JOBS = "jobs as (select doc_id, block_id, page_num, (case when page_num = 0 then 100 else 0 end + n % 7)::double as priority, n from blocks where n % 2 = 0 or block_type = 'formula')"


def _block_jobs(b: DataFrame, scan_round: str) -> DataFrame:
    """Jobs for every other block and all formulas, the first page's first."""
    return b.where("n % 2 = 0 or block_type = 'formula'").selectExpr("cast(doc_id as string) as doc_hash", f"'{scan_round}' as scan_round", "'block' as target_type", "block_id as target_id", "page_num", "'queued' as status", "cast(if(page_num = 0, 100, 0) + n % 7 as double) as priority", "sha2(content, 256) as input_hash", "'' as error", "0L as attempts")


@query(
    "q10_graph_batch",
    f"""with {BLOCKS}, {_JOBS}, r as (select *, row_number() over (partition by doc_id order by priority desc, page_num, block_id) as k from jobs),
    o as (select r.doc_id, r.block_id, case when k > {BUDGET} then 'queued' when r.n % 9 = 4 then 'skipped' when not {_FACTS} then 'skipped' else 'done' end as status, case when k > {BUDGET} then '' when r.n % 9 = 4 then 'block_not_available' when not {_FACTS} then 'no_structural_graph_facts' else '' end as error from r join blocks b on b.doc_id = r.doc_id and b.block_id = r.block_id)
    select doc_id::varchar as doc_hash, count(*) filter (where status = 'done') as processed, count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'queued') as pending, count(*) filter (where error = 'block_not_available') as gone from o group by doc_id""",
)
def q10(spark, sf_dir):
    """One graph batch of each document: within the budget, blocks that state facts are done; shadowed ones count as gone here."""
    b = blocks(spark, sf_dir)
    facts = b.where(_FACTS).selectExpr("cast(doc_id as string) as doc_hash", "block_id as target_id", "3 as n")
    there = b.where("n % 9 <> 4").selectExpr("cast(doc_id as string) as doc_hash", "block_id as target_id")
    s = R.graph_batch(_block_jobs(b, "knowledge_graph"), there, facts, BUDGET)
    return s.groupBy("doc_hash").agg(F.expr("count_if(status = 'done')").alias("processed"), F.expr("count_if(status = 'skipped')").alias("skipped"), F.expr("count_if(status = 'queued')").alias("pending"), F.expr("count_if(error = 'block_not_available')").alias("gone"))


@query(
    "q11_update_batch",
    f"""with {BLOCKS}, {_JOBS}, idx as (select distinct doc_id from blocks where doc_id % 4 <> 0), r as (select *, row_number() over (partition by doc_id order by priority desc, page_num, block_id) as k from jobs where doc_id in (select doc_id from idx)),
    x as (select j.doc_id, j.block_id, r.k, case when j.n % 9 = 4 then null else b.block_type end as kind, b.content, case when j.n % 4 = 0 then 'x_{{' || j.n || '}}' end as latex from jobs j join blocks b on b.doc_id = j.doc_id and b.block_id = j.block_id left join r on r.doc_id = j.doc_id and r.block_id = j.block_id),
    o as (select *, case when k is null or k > {BUDGET} then 'queued' when kind = 'formula' or (kind is null and latex is not null) then 'done' else 'skipped' end as status from x)
    select doc_id::varchar as doc_hash, block_id as target_id, status, case when status = 'done' then md5(coalesce(latex, content)) end as content_md5, case when status = 'done' then latex is not null end as graph_synced from o""",
)
def q11(spark, sf_dir):
    """One update batch of each document that has an index: accepted results replace formulas or stand in for gone ones, others wait or are skipped."""
    b = blocks(spark, sf_dir).withColumn("doc_hash", F.col("doc_id").cast("string")).withColumnRenamed("block_id", "target_id")
    accepted = b.where("n % 4 = 0").selectExpr("doc_hash", "target_id", "concat('x_{', n, '}') as latex")
    jobs = _block_jobs(blocks(spark, sf_dir), "knowledge_incremental_update")
    state, upserts = R.update_batch(jobs, b.where("n % 9 <> 4").select("doc_hash", "target_id", "block_type", "content"), accepted, b.where("doc_id % 4 <> 0").select("doc_hash"), BUDGET)
    return state.join(upserts, ["doc_hash", "target_id"], "left").selectExpr("doc_hash", "target_id", "status", "md5(content) as content_md5", "graph_synced")


#: Work of a round on each page.
LIMIT = 2
BORN = ("parsed_blocks", "pdf_structure", "inline_spans")
_BORN = ", ".join(f"'{x}'" for x in BORN)
#: The precise and the semantic round: what each asks of a group, and the stage of the evidence that it adds.
STEPS = (("r2", "local_precise", "precise is null"), ("r3", "cloud_semantic", "true"))


def run_rounds(evidence: DataFrame, available: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(step, round, status, n) after each round; candidates (as ``formulas``) that are there, and those that rounds can make.

    Each round asks for the groups that the fusion before it leaves without enough evidence, within ``limit`` of each page, the least similar first; what it makes counts in the
    next fusion. A group for which nothing can be made is skipped. Ready groups go on to the graph, and from there to the update.
    """
    evidence = cut(evidence)
    pages = cut(evidence.unionByName(available).groupBy("candidate_id").agg(F.min("page_num").alias("page_num")))
    out = None

    def note(step: str, rows: DataFrame, name: str, status: str) -> None:
        nonlocal out
        one = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(name).alias("round"), "status", "n")
        out = one if out is None else out.unionByName(one)

    note("r0", evidence, "structure", "stage")
    fused = fusion_rows(evidence)
    note("after_r1", fused, "fusion", "decision")
    for step, stage, asks in STEPS:
        asked = fused.where(f"decision = 'needs_more_evidence' and {asks}").join(pages, "candidate_id")
        place = "row_number() over (partition by page_num order by best.similarity, candidate_id)"
        queue = asked.select("candidate_id", F.expr(f"{place} <= {limit}").alias("runs"))
        made = available.where(F.col("stage") == stage).join(queue.where("runs").select("candidate_id"), "candidate_id", "left_semi")
        there = made.select("candidate_id").distinct().withColumn("there", F.lit(True))
        done = queue.join(there, "candidate_id", "left").withColumn("outcome", F.expr("case when not runs then 'queued' when there then 'done' else 'skipped' end"))
        note(step, done, stage, "outcome")
        evidence = cut(evidence.unionByName(made.select(*evidence.columns)))
        fused = fusion_rows(evidence)
        note(f"after_{step}", fused, "fusion", "decision")
    ready = fused.withColumn("fact", F.expr("if(decision = 'ready_for_manual_accept', if(trim(best.latex) <> '', 'done', 'skipped'), 'waiting')"))
    note("r4", ready, "knowledge_graph", "fact")
    note("r5", ready.where("fact = 'done'").withColumn("fate", F.expr("if(size(risk_flags) = 0, 'updated', 'review')")), "knowledge_update", "fate")
    return out


def _step_sql(step: str, stage: str, asks: str, before: str) -> str:
    return f"""{step}q as (select candidate_id, row_number() over (partition by page_num order by best_similarity, candidate_id) <= {LIMIT} as runs from {before} join pg using (candidate_id) where decision = 'needs_more_evidence' and {asks}),
    {step}m as (select * from formulas where stage = '{stage}' and candidate_id in (select candidate_id from {step}q where runs)),
    {step}o as (select case when not runs then 'queued' when candidate_id in (select candidate_id from {step}m) then 'done' else 'skipped' end as status from {step}q)"""


@query(
    "d02_rounds",
    f"""with {FORMULAS}, ev0 as (select * from formulas where stage in ({_BORN})), pg as (select candidate_id, min(page_num) as page_num from formulas group by candidate_id), {fusion_sql('ev0', 'ga', 'ra')},
    {_step_sql('r2', 'local_precise', 'precise is null', 'ga')}, ev1 as (select * from ev0 union all select * from r2m), {fusion_sql('ev1', 'gb', 'rb')},
    {_step_sql('r3', 'cloud_semantic', 'true', 'gb')}, ev2 as (select * from ev1 union all select * from r3m), {fusion_sql('ev2', 'gc', 'rc')},
    f as (select *, case when decision = 'ready_for_manual_accept' then case when trim(best_latex) <> '' then 'done' else 'skipped' end else 'waiting' end as fact from gc)
    select 'r0' as step, 'structure' as round, stage as status, count(*) as n from ev0 group by stage union all select 'after_r1', 'fusion', decision, count(*) from ga group by decision
    union all select 'r2', 'local_precise', status, count(*) from r2o group by status union all select 'after_r2', 'fusion', decision, count(*) from gb group by decision
    union all select 'r3', 'cloud_semantic', status, count(*) from r3o group by status union all select 'after_r3', 'fusion', decision, count(*) from gc group by decision
    union all select 'r4', 'knowledge_graph', fact, count(*) from f group by fact union all select 'r5', 'knowledge_update', case when len(risk_flags) = 0 then 'updated' else 'review' end, count(*) from f where fact = 'done' group by 3""",
)
def d02(spark, sf_dir):
    """The rounds one after the other: each works on what the fusion before it lacks, and its evidence counts in the next."""
    f = formulas(spark, sf_dir)
    return run_rounds(f.where(f"stage in ({_BORN})"), f.where(f"stage not in ({_BORN})"))
