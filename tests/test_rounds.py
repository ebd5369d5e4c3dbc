"""Jobs by rounds, services by name, caches and the newer readers."""

import pytest
from pyspark.sql import functions as F

from foliogrid.functions import services as V
from foliogrid.operators import caches, rounds
from foliogrid.sources import readers
from foliogrid.streaming import jobs

STATE = "doc_hash string, scan_round string, target_type string, target_id string, page_num int, status string, priority double, input_hash string, error string, attempts long"


def state(spark, *rows):
    return spark.createDataFrame([("d", "r", "block", t, 0, status, p, h, "", 0) for t, status, p, h in rows], STATE)


def test_records_are_queued_once_for_an_input(spark):
    s = state(spark, ("a", "done", 1.0, "h1"), ("b", "done", 1.0, "h1"), ("c", "failed", 9.0, "h1"), ("e", "running", 1.0, None))
    new = spark.createDataFrame([("d", "a", 0, 5.0, "h1"), ("d", "b", 0, 5.0, "h2"), ("d", "c", 0, 5.0, "h1"), ("d", "n", 2, 1.0, "h"), ("d", "n", 2, 3.0, "h"), ("d", "m", -1, 1.0, "h"), ("d", "a", 0, 2.0, None)], "doc_hash string, target_id string, page_num int, priority double, input_hash string")
    got = {r.target_id: (r.status, r.priority, r.input_hash, r.inserted) for r in rounds.enqueue_records(s, new, "r").collect()}
    assert got == {"a": ("done", 5.0, "h1", False), "b": ("queued", 5.0, "h2", True), "c": ("queued", 9.0, "h1", True), "e": ("running", 1.0, None, False), "n": ("queued", 3.0, "h", True)}


def test_pages(spark):
    s = spark.createDataFrame([("d", "r", "page", "1", 1, "done", 1.0, None, "x", 1), ("d", "r", "page", "2", 2, "failed", 1.0, None, "x", 1)], STATE)
    new = spark.createDataFrame([("d", 1, 2.0), ("d", 2, 0.5), ("d", 3, 1.0), ("d", 3, 4.0), ("d", -2, 1.0)], "doc_hash string, page_num int, priority double")
    got = {r.target_id: (r.status, r.priority, r.error, r.inserted) for r in rounds.enqueue_pages(s, new, "r").collect()}
    assert got == {"1": ("done", 2.0, "x", False), "2": ("queued", 1.0, "", True), "3": ("queued", 4.0, "", True)}
    assert rounds.enqueue_pages(s.where("false"), new.where("false"), "r").count() == 0


def test_batches(spark):
    s = state(spark, *[(x, "queued", p, "h") for x, p in (("a", 5.0), ("b", 4.0), ("c", 3.0), ("e", 2.0))])
    there = spark.createDataFrame([("d", "a"), ("d", "c"), ("d", "e")], "doc_hash string, target_id string")
    facts = spark.createDataFrame([("d", "a", 3), ("d", "e", 1)], "doc_hash string, target_id string, n int")
    got = {r.target_id: (r.status, r.error, r.attempts) for r in rounds.graph_batch(s, there, facts, 3, "r").collect()}
    assert got == {"a": ("done", "", 1), "b": ("skipped", "block_not_available", 1), "c": ("skipped", "no_structural_graph_facts", 1), "e": ("queued", "", 0)}
    blocks = spark.createDataFrame([("d", "a", "formula", "x"), ("d", "b", "paragraph", "y")], "doc_hash string, target_id string, block_type string, content string")
    accepted = spark.createDataFrame([("d", "a", " z "), ("d", "c", "w"), ("d", "e", " ")], "doc_hash string, target_id string, latex string")
    after, upserts = rounds.update_batch(s, blocks, accepted, there.select("doc_hash"), 9, "r")
    assert {r.target_id: (r.status, r.error) for r in after.collect()} == {"a": ("done", ""), "b": ("skipped", "missing_formula_block"), "c": ("done", ""), "e": ("skipped", "missing_formula_block")}
    assert {(r.target_id, r.content, r.graph_synced) for r in upserts.collect()} == {("a", "z", True), ("c", "w", True)}
    waits, none = rounds.update_batch(s, blocks, accepted, there.where("false").select("doc_hash"), 9, "r")
    assert none.count() == 0 and {r.status for r in waits.collect()} == {"queued"}


def test_errors_are_cut(spark):
    s = state(spark, ("a", "queued", 1.0, "h"))
    out = s.selectExpr(*rounds.KEY, "'failed' as outcome", "repeat('x', 900) as reason")
    assert [(r.status, len(r.error), r.attempts) for r in rounds.settled(s, out).collect()] == [("failed", 500, 1)]


def test_services(spark):
    keys = {"deepseek/other": "k1", "glm-4": "k2"}
    assert V.api_key(" deepseek-chat ", keys, {}) == "k1" and V.api_key("glm-4-plus", keys, {}) == "k2"
    assert V.api_key("openai/gpt-4o", keys, {"OPENAI_API_KEY": "e"}) == "e" and V.api_key("openai/gpt-4o", {}, {"OPENAI_GPT_4O_API_KEY": "m", "OPENAI_API_KEY": "e"}) == "m" and V.api_key("", {}, {}) is None
    base = {"ui": {"theme": "light", "size": 1}, "keys": {"a": 1}}
    assert V.merged(base, {"ui": {"theme": "dark"}, "keys": 3, "new": {"x": 1}}) == {"ui": {"theme": "dark", "size": 1}, "keys": 3, "new": {"x": 1}} and base["ui"]["theme"] == "light"
    now = spark.range(1).select(V.iso_now().alias("t")).first().t
    assert now.endswith("+00:00") and len(now) == 32


def test_caches_evict_the_longest_unused():
    got = caches.replay([("put", "a", 60), ("put", "b", 30), ("get", "a", 0), ("put", "c", 20), ("get", "b", 0), ("put", "a", 10), ("drop", "c", 0), ("get", "z", 0), ("put", "d", 500)], 100)
    assert got == [(False, 0, 60), (False, 0, 90), (True, 0, 90), (False, 1, 80), (False, 0, 80), (True, 0, 30), (True, 0, 10), (False, 0, 10), (False, 2, 0)]


def test_indexes_replace_documents_and_leave_others(spark, tmp_path):
    where = f"{tmp_path}/index"
    one = spark.range(40).selectExpr("id % 8 as doc_id", "concat('b', id) as block_id", "'old' as content")
    readers.write_index(one, where, 4)
    readers.write_index(spark.createDataFrame([(3, "n", "new")], "doc_id long, block_id string, content string"), where, 4)
    got = readers.read_index(spark, where)
    assert got.where("doc_id = 3").collect()[0].content == "new" and got.where("doc_id = 3").count() == 1 and got.where("doc_id <> 3").count() == 35
    vectors = spark.createDataFrame([(1, "v", [1.0, 2.0])], "doc_id long, id string, embedding array<double>")
    readers.write_vectors(vectors, f"{tmp_path}/vectors")
    assert readers.read_index(spark, f"{tmp_path}/vectors").schema["embedding"].dataType.simpleString() == "array<float>"


def test_chunks_outlines_and_first_pages(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"a": {i}}}\n' for i in range(10)) + "\n[1]\n")
    chunks = readers.json_chunks(spark, f"{tmp_path}/a.jsonl", "a int", 4).orderBy("chunk").collect()
    assert [[x.a for x in r.rows] for r in chunks] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    toc = spark.createDataFrame([("d", 0, 1, " One ", 1), ("d", 1, 2, "", 2), ("d", 2, 2, "x", 0), ("d", 3, 1, "Two", 9)], "doc_id string, n int, level int, title string, page int")
    assert [(r.title, r.page_num) for r in readers.outline(toc).orderBy("n").collect()] == [("One", 0), ("Two", 8)]
    early, rest = readers.first_pages(spark.range(20).withColumnRenamed("id", "page_num"))
    assert early.count() == 8 and rest.count() == 12


def test_sources_of_macros(spark):
    files = spark.createDataFrame([("main.tex", "\\documentclass[a4]{own}\\usepackage{one, two}% \\usepackage{three}\n\\input{part}"), ("own.cls", "\\RequirePackage{one}"), ("lib/one.sty", "\\RequirePackage{four}"), ("two.sty", ""), ("three.sty", ""), ("part.tex", "\\input{main}"), ("four.sty", "")], "path string, text string")
    assert {(r.path, r.level) for r in readers.needed_files(files, "main.tex").collect()} == {("main.tex", 0), ("own.cls", 1), ("lib/one.sty", 1), ("two.sty", 1), ("part.tex", 1), ("four.sty", 2)}


def test_late_results_are_dropped(spark, tmp_path):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "key string, version int")
    results = spark.createDataFrame([("a", 1, "late"), ("a", 2, "now"), ("b", 4, "late"), ("c", 1, "none")], "key string, version int, value string")
    assert [r.value for r in jobs.current_results(results, requests).collect()] == ["now"]
    requests.write.parquet(f"{tmp_path}/requests")
    results.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(results.schema).parquet(f"{tmp_path}/in")
    jobs.keep_current(stream, f"{tmp_path}/requests", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["now"]


@pytest.mark.parametrize("strategy,up,want", [("local_only", "c", None), ("cloud_only", "lc", "cloud"), ("cloud_only", "lrb", "reasoning"), ("local_first", "lc", "local"), ("local_first", "rc", "cloud"), ("cloud_only", "b", "fallback"), ("local_first", "", None)])
def test_routes(spark, strategy, up, want):
    row = spark.range(1).select(*[F.lit(k in up).alias(k) for k in "lcrb"], F.lit("translation").alias("t"), F.lit(strategy).alias("s"))
    assert row.selectExpr(f"{V.route('t', 's', 'l', 'c', 'r', 'b')} as x").first().x == want
