"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

from __future__ import annotations

import pytest
from conftest import DATA, rows_of

from engram import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.SQL:
        want = duck.sql(plans.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_sql_has_queries():
    assert set(plans.SQL) <= set(plans.QUERIES)
