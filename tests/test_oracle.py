"""Every core query with SQL, compared over the smallest tables."""

import pytest
from oracle import assert_same

from verbloom.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    assert_same(spark, data, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert df.count() >= 0 and df.columns


def test_flagship(spark, data):
    assert registry.flagship(spark, data).count() == 7


def test_core_does_not_import_llm():
    from pathlib import Path

    import verbloom

    root = Path(verbloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "verbloom.llm" not in p.read_text(), p
