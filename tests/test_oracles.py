"""Every query with a DuckDB text must agree with it; the others must return rows."""

import pytest

from checks import load
from checks.compare import compare, connect

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, SF, name, QUERIES, ORACLES)
    assert ok, text
