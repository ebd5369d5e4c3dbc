"""Relation edges by page, and decoding that makes no more than it is asked for."""

import pytest
from pyspark.sql import functions as F

from foliogrid.operators import decode
from foliogrid.plans.base import glyphs
from foliogrid.plans.glyphs import relation_edges

PATH = "/root/testdata/sf0.001"


def test_first_structure_alone_takes_no_beams(spark, monkeypatch):
    rows = [(p, f"n{i}", f"n{j}", kind, 0.5 + (i * 7 + j * 3 + p) % 10 / 20) for p in range(3) for i in range(5) for j in range(5) if i != j for kind in ("NEXT", "SUP")]
    every = spark.createDataFrame(rows, "row_id long, source string, target string, relation string, confidence double").coalesce(1)
    whole = sorted(decode.decode(every).where("rank = 1").collect())
    assert sorted(decode.decode(every, best=1).collect()) == whole and len(whole) == 3
    assert decode.decode(every).where("rank > 1").count()
    page = lambda sides, keys, run, columns: list(run([r[1:] for r in rows if r[0] == 0]))
    monkeypatch.setattr(decode, "mapped_pages", page)
    monkeypatch.setattr(decode, "beams", lambda *a: pytest.fail("beams for rank 1"))
    assert len(decode.decode(every, best=1)) == 1


def test_node_ids_that_come_again_on_other_pages(spark):
    g = glyphs(spark, PATH)
    by_page = relation_edges(g).groupBy("s_page_num").count()
    again = relation_edges(g.withColumn("node_id", F.concat(F.lit("g"), F.col("idx")))).groupBy("s_page_num").count()
    assert sorted(by_page.collect()) == sorted(again.collect())


def test_pairs_of_small_pages_are_ranked_where_they_lie(spark):
    text = relation_edges(glyphs(spark, PATH))._jdf.queryExecution().executedPlan().toString()
    assert text.index("Union") < text.index("Window")  # each side is ranked before both are united
