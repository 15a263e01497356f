"""The registered queries: one for each operator and the pipeline, and those with SQL against it."""

import pytest

from __spark_entry__ import oracle_sql, queries
from checks import compare
from leadloom.llm.oracles import ORACLES
from leadloom.llm.queries import QUERIES


def test_every_operator_and_the_pipeline_are_registered():
    names = set(queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, small, monkeypatch, name):
    monkeypatch.setitem(compare.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(compare.ORACLES, name, ORACLES[name])
    assert compare.differences(spark, compare.duck(small), small, name) is None
