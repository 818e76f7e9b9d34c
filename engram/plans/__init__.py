"""The catalogue of queries over the driver's tables: one Spark plan and, where SQL can say it, one SQL text each."""

from __future__ import annotations

from engram.plans import graph, memory, search, text

_PARTS = (search, memory, graph, text)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
