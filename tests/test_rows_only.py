"""Queries without SQL twins: they run, have rows and the same rows again."""

import pytest

import foliogrid.registry as registry

PATH = "/root/testdata/sf0.001"
NAMES = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", NAMES)
def test_runs_and_repeats(spark, name):
    first = sorted(map(str, registry.queries()[name](spark, PATH).collect()))
    assert first and first == sorted(map(str, registry.queries()[name](spark, PATH).collect()))
