"""Every query of the subpackage runs at the smallest scale and equals its SQL where it has one."""

import pytest
from sqlcheck import assert_same

from tunelore.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    if name in queries.SQL:
        assert_same(df, queries.SQL[name], folder)
    else:
        rows = df.collect()
        assert rows and len(rows) == len(set(map(str, rows)))
