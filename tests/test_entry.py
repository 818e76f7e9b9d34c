from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())
    assert entry.entry(spark).columns == ["id", "score"]
