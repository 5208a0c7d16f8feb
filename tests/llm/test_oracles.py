"""Queries with a DuckDB text must agree with it."""

import pytest

from checks.compare import compare, connect
from monthloom.llm.queries import load

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    text, _, ok = compare(spark, connect(SF), SF, name, QUERIES, ORACLES)
    assert ok, text
