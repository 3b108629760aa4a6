"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import pytest

from rankloom.plans import registry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same(spark, con, name):
    assert compare(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""
