"""Queries of the entity graph and of calls, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions.text import normalize_entity
from engram.operators import graph
from engram.plans.memory import ENT, MEM
from engram.sources import tables

START, DEPTH = "s1", 3


def _related(s, d, **k):
    return graph.related(tables.relationships(s, d), START, DEPTH, limit=50, **k).select("id", "strength", "hops")


def _mentions(s, d):
    """A mention of a nation for each of its customers."""
    n = tables.read(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = tables.read(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return c.join(n, "c_nationkey").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name")).alias("name"), F.lit("GPE").alias("type"), F.lit(1).cast("long").alias("mentions"), (F.col("c_custkey") % 100 / 100).alias("confidence"))


def _updates(s, d):
    c = tables.read(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("name"), (F.col("c_custkey") % 100).cast("string")).alias("name"), F.col("c_custkey").alias("updated_at"))
    return c.where("id < 'c5'"), c.where("id >= 'c5'")


def _names(s, d):
    c = tables.read(s, d, "part").select("p_partkey", F.concat(F.lit(" the  "), "p_name", F.lit(" Programming  language ")).alias("name"))
    kinds = ("TECHNOLOGY", "ORG", "GPE", "DATE")
    return c.select("p_partkey", *[normalize_entity(F.col("name"), F.lit(k)).alias(k.lower()) for k in kinds])


def _export(kind):
    return lambda s, d: graph.FORMATS[kind](tables.entities(s, d), tables.relationships(s, d))


def _upserted(s, d):
    c = tables.calls(s, d)
    return graph.upsert_calls(c.where("line <= 3"), c.where("line >= 3")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("args").alias("args"))


def _status(s, d):
    """Nodes are entities and memories; the health rule looks at both counts. A workspace without entities is a warning."""
    m, n, e = tables.memories(s, d), tables.entities(s, d), tables.relationships(s, d)
    counts = [x.agg(F.count(F.lit(1)).alias(c)) for x, c in ((m, "n_memories"), (e, "n_edges"))]
    one = n.agg(F.count(F.lit(1)).alias("n_entities"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).crossJoin(counts[0]).crossJoin(counts[1])
    empty = m.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).join(n.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("e")), "workspace_id", "full")
    spaces = empty.select("workspace_id", graph.health(F.coalesce("n", F.lit(0)) + F.coalesce("e", F.lit(0)), F.coalesce("e", F.lit(0))).alias("health"))
    return spaces.crossJoin(one)


def _cooccur(s, d):
    m = tables.read(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("entity"))
    return graph.cooccurrence(m, 3)


QUERIES = {
    "entity_dedupe": lambda s, d: graph.dedupe_entities(_mentions(s, d)).select(F.lower("name").alias("name"), "mentions", F.round("confidence", 6).alias("confidence")),
    "entity_upsert_latest": lambda s, d: graph.upsert_entities(*_updates(s, d)),
    "entity_merge_counts": lambda s, d: graph.merge_counts(tables.entities(s, d).where("type = 'GPE'"), tables.entities(s, d)),
    "entity_normalize": _names,
    "entity_ranked": lambda s, d: graph.ranked_entities(tables.entities(s, d), 0.7, 50).select("id", F.round("confidence", 6).alias("confidence")),
    "relationships_checked": lambda s, d: graph.add_relationships(tables.relationships(s, d), tables.entities(s, d), tables.relationships(s, d).select(F.col("dst").alias("src"), F.concat(F.lit("r"), F.length("src").cast("string")).alias("dst"), "type", (F.col("strength") * 1.2).alias("strength"))).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
    "related_mean": _related,
    "related_product": lambda s, d: _related(s, d, score="product"),
    "related_filtered_types": lambda s, d: _related(s, d, types=["LOCATED_IN"]),
    "entity_type_counts": lambda s, d: graph.type_counts(tables.entities(s, d)),
    "graph_health": _status,
    "subgraph_edges": lambda s, d: graph.subgraph(tables.entities(s, d), tables.relationships(s, d), ["GPE", "ORG"])[1],
    **{f"export_{k}": _export(k) for k in graph.FORMATS},
    "callers_of": lambda s, d: graph.callers(tables.calls(s, d), "g7"),
    "callees_of": lambda s, d: graph.callees(tables.calls(s, d), "f7"),
    "calls_upsert": _upserted,
    "cooccurrence_edges": _cooccur,
    "mentions_capitalised": lambda s, d: graph.capitalised_mentions(tables.read(s, d, "documents")),
}


def _walk(score, types=""):
    e = f"SELECT * FROM relationships {types}"
    total = "list_sum(s) / len(s)" if score == "mean" else "list_product(s)"
    return f"""WITH RECURSIVE {ENT}, e AS (SELECT row_number() OVER () AS k, * FROM ({e})), h AS (SELECT k, src AS a, dst AS b, strength FROM e UNION ALL SELECT k, dst, src, strength FROM e WHERE src <> dst),
w(id, seen, s) AS (SELECT b, [k], [strength] FROM h WHERE a = '{START}' UNION ALL SELECT h.b, list_append(seen, k), list_append(s, strength) FROM w JOIN h ON h.a = w.id WHERE len(s) < {DEPTH} AND NOT list_contains(seen, k))
SELECT DISTINCT id, round({total}, 6) AS strength, len(s) AS hops FROM w WHERE id <> '{START}' ORDER BY strength DESC, id, hops LIMIT 50"""


_XML = "replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _lines(node, edge):
    return f"WITH {ENT} SELECT 'node' AS kind, id AS key, {node} AS line FROM entities UNION ALL SELECT 'edge', src || '>' || dst, {edge} FROM relationships"


_CALLS = "calls AS (SELECT 'f' || l_suppkey AS caller, 'g' || l_partkey AS callee, l_linenumber::BIGINT AS line, CASE l_returnflag WHEN 'A' THEN 'function' WHEN 'N' THEN 'method' ELSE 'constructor' END AS type, floor(l_quantity % 5)::BIGINT AS args FROM lineitem)"
_WORDS = "list_filter(string_split(p_name, ' '), lambda x: x <> '')"
_TITLE = f"array_to_string(list_transform({_WORDS}, lambda w: array_to_string(list_transform(regexp_extract_all(w, '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')), ' ')"

SQL = {
    "entity_dedupe": "SELECT lower(n_name) AS name, count(*) AS mentions, round(max(c_custkey % 100 / 100), 6) AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
    "entity_upsert_latest": "WITH c AS (SELECT 'c' || c_custkey AS id, 'name' || (c_custkey % 100) AS name, c_custkey AS updated_at FROM customer) SELECT id, name, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id >= 'c5' DESC, updated_at DESC, id DESC) AS r FROM c) WHERE r = 1",
    "entity_merge_counts": f"WITH {ENT}, k AS (SELECT DISTINCT lower(trim(name)) AS n, lower(type) AS t FROM entities) SELECT count(*) FILTER (t <> 'gpe') AS created, count(*) FILTER (t = 'gpe') AS merged FROM k",
    "entity_normalize": f"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '[A-Z]') THEN array_to_string({_WORDS}, ' ') ELSE {_TITLE} END AS technology, 'The ' || {_TITLE} AS org, 'The ' || {_TITLE} AS gpe, 'the ' || array_to_string({_WORDS}, ' ') AS date FROM part",
    "entity_ranked": f"WITH {ENT} SELECT id, round(confidence, 6) AS confidence FROM entities WHERE confidence >= 0.7 ORDER BY entities.confidence DESC, name LIMIT 50",
    "relationships_checked": f"WITH {ENT}, n AS (SELECT dst AS src, 'r' || length(src) AS dst, type, strength * 1.2 AS strength FROM relationships), k AS (SELECT type FROM relationships UNION ALL SELECT type FROM n WHERE strength BETWEEN 0 AND 1 AND src IN (SELECT id FROM entities) AND dst IN (SELECT id FROM entities)) SELECT type, count(*) AS n FROM k GROUP BY 1",
    "related_mean": _walk("mean"),
    "related_product": _walk("product"),
    "related_filtered_types": _walk("mean", "WHERE type = 'LOCATED_IN'"),
    "entity_type_counts": f"WITH {ENT}, t AS (SELECT unnest({list(graph.ENTITY_TYPES)}) AS type), c AS (SELECT type, count(*) AS n FROM entities GROUP BY 1) SELECT coalesce(t.type, c.type) AS type, coalesce(n, 0) AS n FROM t FULL JOIN c ON t.type = c.type",
    "graph_health": f"WITH {MEM}, {ENT}, w AS (SELECT coalesce(m.w, e.w) AS workspace_id, coalesce(m.n, 0) AS n, coalesce(e.n, 0) AS k FROM (SELECT workspace_id AS w, count(*) AS n FROM memories GROUP BY 1) m FULL JOIN (SELECT 'default' AS w, count(*) AS n FROM entities) e ON m.w = e.w) SELECT workspace_id, CASE WHEN n + k = 0 THEN 'Critical' WHEN k = 0 THEN 'Warning' ELSE 'Healthy' END AS health, (SELECT count(*) FROM entities) AS n_entities, (SELECT round(avg(confidence), 6) FROM entities) AS mean_confidence, (SELECT count(*) FROM memories) AS n_memories, (SELECT count(*) FROM relationships) AS n_edges FROM w",
    "subgraph_edges": f"WITH {ENT}, n AS (SELECT id FROM entities WHERE type IN ('GPE', 'ORG')) SELECT src, dst, type, strength FROM relationships WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
    "export_json": _lines("json_object('id', id, 'labels', ['Entity'], 'properties', json_object('name', name, 'type', type, 'confidence', confidence::DOUBLE))::VARCHAR", "json_object('id', src || '-' || type || '-' || dst, 'source', src, 'target', dst, 'type', type, 'properties', json_object('strength', strength::DOUBLE))::VARCHAR"),
    "export_cytoscape": _lines("json_object('data', json_object('id', id, 'label', name, 'name', name, 'type', type, 'confidence', confidence::DOUBLE))::VARCHAR", "json_object('data', json_object('id', src || '-' || type || '-' || dst, 'source', src, 'target', dst, 'label', type, 'strength', strength::DOUBLE))::VARCHAR"),
    "export_graphml": _lines(f"""'<node id="' || id || '"><data key="name">' || {_XML} || '</data><data key="type">' || type || '</data><data key="confidence">' || confidence::DOUBLE || '</data></node>'""", """'<edge id="' || src || '-' || type || '-' || dst || '" source="' || src || '" target="' || dst || '"><data key="label">' || type || '</data><data key="strength">' || strength::DOUBLE || '</data></edge>'"""),
    "export_cypher": _lines("""'CREATE (:Entity {id: ' || to_json(id) || ', name: ' || to_json(name) || ', type: ' || to_json(type) || ', confidence: ' || confidence::DOUBLE || '});'""", """'MATCH (a {id: ' || to_json(src) || '}), (b {id: ' || to_json(dst) || '}) CREATE (a)-[:' || type || ' {strength: ' || strength::DOUBLE || '}]->(b);'"""),
    "callers_of": f"WITH {_CALLS} SELECT caller, line, type, args, count(*) AS n FROM calls WHERE callee = 'g7' GROUP BY ALL ORDER BY n DESC, caller, line, type, args LIMIT 100",
    "callees_of": f"WITH {_CALLS} SELECT callee, line, type, args, count(*) AS n FROM calls WHERE caller = 'f7' GROUP BY ALL ORDER BY n DESC, callee, line, type, args LIMIT 100",
    "calls_upsert": f"WITH {_CALLS}, b AS (SELECT 0 AS new, * FROM calls WHERE line <= 3 UNION ALL SELECT 1, * FROM calls WHERE line >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY caller, callee, line ORDER BY new DESC, type DESC, args DESC) AS k FROM b) SELECT type, count(*) AS n, sum(args)::BIGINT AS args FROM r WHERE k = 1 GROUP BY type",
    "cooccurrence_edges": "WITH m AS (SELECT DISTINCT l_orderkey AS o, 's' || l_suppkey AS e FROM lineitem) SELECT a.e AS src, b.e AS dst, count(*) AS n FROM m a JOIN m b ON a.o = b.o AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 3",
    "mentions_capitalised": "SELECT doc_id, entity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1)) AS entity FROM documents) GROUP BY 1, 2",
}
