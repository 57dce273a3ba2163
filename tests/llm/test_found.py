"""Every query with SQL over the smallest tables, and the isolation of the package."""

import pytest
from oracle import assert_same

from verbloom.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    assert_same(spark, data, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
