"""Every core query runs at the smallest scale and equals its SQL where it has one."""

import pytest
from sqlcheck import assert_same

from tunelore.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    if name in registry.SQL:
        assert_same(df, registry.SQL[name], folder)
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
