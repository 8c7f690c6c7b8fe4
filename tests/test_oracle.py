"""Every query of the interval engine against its SQL."""

import oracle
import pytest

from intervalia.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert oracle.differences(spark, name, QUERIES[name], SQL[name], "/root/testdata/sf0.001") == ""
