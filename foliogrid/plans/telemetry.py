"""Telemetry: log levels, latencies, percentiles, budgets and JSON columns of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliogrid.plans.base import query
from foliogrid.session import table


def log_lines(spark, sf_dir):
    """Events as lines of a log, to be read by patterns."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' [', case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' else 'INFO' end, '] ', event_type, ' took=', cast(cast(value * 100 as long) as string), 'ms page=', event_id % 30) as line")


_LOG = "log as (select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' else 'INFO' end || '] ' || event_type || ' took=' || (trunc(value * 100))::bigint || 'ms page=' || (event_id % 30) as line from events)"


@query("a32_log_levels", rf"with {_LOG} select regexp_extract(line, '\[([A-Z]+)\]', 1) as level, count(*) as n, count(*) filter (where regexp_matches(line, 'purchase|view')) as work from log group by 1")
def a32(spark, sf_dir):
    return log_lines(spark, sf_dir).groupBy(F.expr("regexp_extract(line, '\\\\[([A-Z]+)\\\\]', 1)").alias("level")).agg(F.count("*").alias("n"), F.expr("count_if(line rlike 'purchase|view')").alias("work"))


@query("a32_latency_series", rf"with {_LOG}, s as (select regexp_extract(line, '\] (\w+) ', 1) as step, regexp_extract(line, 'took=(\d+)ms', 1)::double as ms from log) select step, count(*) as n, max(ms) as most, round(avg(ms), 6) as mean, round(quantile_cont(ms, 0.95), 6) as p95 from s group by step")
def latency(spark, sf_dir):
    """Latencies by step: count, largest, mean, p95 by interpolation."""
    s = log_lines(spark, sf_dir).selectExpr("regexp_extract(line, '\\\\] (\\\\w+) ', 1) as step", "cast(regexp_extract(line, 'took=(\\\\d+)ms', 1) as double) as ms")
    return s.groupBy("step").agg(F.count("*").alias("n"), F.max("ms").alias("most"), F.round(F.avg("ms"), 6).alias("mean"), F.expr("round(percentile(ms, 0.95), 6)").alias("p95"))


@query("a32_budgets", rf"with {_LOG}, s as (select regexp_extract(line, '\] (\w+) ', 1) as step, regexp_extract(line, 'took=(\d+)ms', 1)::double as ms from log), g as (select step, quantile_cont(ms, 0.95) as p95, max(ms) as most from s group by step) select step, p95 > 350 as p95_over, most > 700 as max_over from g where p95 > 350 or most > 700")
def budgets(spark, sf_dir):
    """Steps over their budget: p95 beyond it, or the largest beyond twice it."""
    s = log_lines(spark, sf_dir).selectExpr("regexp_extract(line, '\\\\] (\\\\w+) ', 1) as step", "cast(regexp_extract(line, 'took=(\\\\d+)ms', 1) as double) as ms")
    g = s.groupBy("step").agg(F.expr("percentile(ms, 0.95)").alias("p95"), F.max("ms").alias("most"))
    return g.where("p95 > 350 or most > 700").selectExpr("step", "p95 > 350 as p95_over", "most > 700 as max_over")


@query("g22_json_columns", """with j as (select event_id, case when event_id % 17 = 0 then '{broken' else props end as props from events) select event_id, case when json_valid(props) then try_cast(json_extract_string(props, '$.k') as int) end as k, coalesce(case when json_valid(props) then try_cast(json_extract_string(props, '$.page') as int) end, case when json_valid(props) then try_cast(json_extract_string(props, '$.k') as int) end, -1) as page from j""")
def g22(spark, sf_dir):
    """JSON columns read tolerantly: broken text is nothing, and the first path that has a value counts."""
    j = table(spark, sf_dir, "events").selectExpr("event_id", "if(event_id % 17 = 0, '{broken', props) as props")
    k, page = "try_cast(get_json_object(props, '$.k') as int)", "try_cast(get_json_object(props, '$.page') as int)"
    return j.selectExpr("event_id", f"{k} as k", f"coalesce({page}, {k}, -1) as page")


@query("g25_merged_counters", "select user_id % 20 as bucket, event_type as counter, count(*) as n, round(sum(value), 4) as total from events group by all")
def g25(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.expr("user_id % 20").alias("bucket"), F.col("event_type").alias("counter")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("f33_history_window", "with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id, count(*) as kept, string_agg(role || ': ' || left(text, 40), ' | ' order by turn) as context from r where back <= 12 group by conv_id")
def f33(spark, sf_dir):
    """The last twelve messages of a conversation, as context."""
    r = table(spark, sf_dir, "conversations").withColumn("back", F.expr("row_number() over (partition by conv_id order by turn desc)")).where("back <= 12")
    return r.groupBy("conv_id").agg(F.count("*").alias("kept"), F.expr("array_join(transform(array_sort(collect_list(struct(turn, role, text))), s -> concat(s.role, ': ', left(s.text, 40))), ' | ')").alias("context"))


@query("w18_stress_pages", "with c as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as m from events) select user_id, event_id, case when i % 2 = 0 then i // 2 else m - 1 - i // 2 end as place from c")
def w18(spark, sf_dir):
    """Rows dealt out from both ends in turn, low and high."""
    c = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "row_number() over (partition by user_id order by event_id) - 1 as i", "count(*) over (partition by user_id) as m")
    return c.selectExpr("user_id", "event_id", "if(i % 2 = 0, i div 2, m - 1 - i div 2) as place")
