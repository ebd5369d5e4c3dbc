"""Shapes of plans: no product of tables, and scans that read what is asked for."""

import re

import pytest

import foliogrid.registry as registry

PATH = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_products(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(registry.queries()[name](spark, PATH)))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(registry.queries()["p27_training_relations"](spark, PATH))
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in text
    text = plan(registry.queries()["s21_document_ids"](spark, PATH))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "PushedFilters: [IsNotNull(text)]" in text
    text = plan(registry.queries()["d06_bookmarks_reorder"](spark, PATH))
    assert "EqualTo(event_type,click)" in text and "props" not in re.search("ReadSchema: (.*)", text)[1]


def test_sums_before_the_shuffle(spark):
    text = plan(registry.queries()["q04_job_state"](spark, PATH))
    assert "partial_" in text and "Window" not in text
    assert text.count("Exchange") == 1
