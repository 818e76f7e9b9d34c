"""Queries of filters, statistics, versions, lifecycle, latency and event windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions.text import cache_key
from engram.operators import graph, lifecycle, memory, monitor, temporal
from engram.plans.search import BM25, _index
from engram.sources import tables
from engram.streaming import windows

T = "2024-01-15 12:00:00"
_V = ("memory_id", "version")


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _m(s, d, **f):
    return tables.memories(s, d).where(lifecycle.matches(**f)).select("memory_id", "source", "workspace_id")


def _ver(s, d):
    return tables.versions(s, d)


def _probes(s, d):
    return tables.read(s, d, "orders").select(F.col("o_orderkey").alias("probe_id"), F.concat(F.lit("/src/"), (F.col("o_custkey") % 150 % 5).cast("string"), F.lit("/user"), (F.col("o_custkey") % 150).cast("string"), F.lit(".py")).alias("file_path"), (F.expr("timestamp_ntz'2024-01-01'") + F.make_interval(hours=(F.col("o_orderkey") % 700).cast("int"))).alias("t"))


def _first(s, d):
    """The oldest version of user 7: edits act on it."""
    r = _ver(s, d).where("file_path = '/src/2/user7.py' and version = 3").select("memory_id").first()
    return r["memory_id"]


def _shape(df):
    return df.where("file_path = '/src/2/user7.py'").select(*_V, "is_current", _text("valid_to"), _text("transaction_to"))


def _bare(s, d):
    """Memories as they were before versions: every third without a workspace."""
    m = tables.memories(s, d)
    return m.drop("is_current").withColumn("workspace_id", F.when(F.col("memory_id") % 3 != 0, F.col("workspace_id")))


def _mentions(s, d):
    hosts = F.regexp_extract("url", "://([^/?#]*)", 1)
    page = tables.read(s, d, "pages").select(F.explode(F.split(hosts, "\\.")).alias("word"))
    n = tables.entities(s, d).select(F.col("id").alias("entity_id"), F.lower("name").alias("word"))
    return page.join(n, "word").select("entity_id").distinct()


def _entities_and_loose(s, d):
    e = tables.entities(s, d)
    loose = e.where("type = 'GPE'").select(F.concat(F.lit("x"), "id").alias("id"), "name", "type", "confidence", "workspace_id")
    return e.unionByName(loose)


def _stream(s, d, name, schema_of=None):
    schema = s.read.parquet(f"{d}/{name}.parquet").schema
    return s.readStream.schema(schema).format("parquet").option("pathGlobFilter", f"{name}.parquet").load(d)


def _rows_in(s, d):
    """Documents as they come in: some blank, some with metadata that isn't JSON, some without a workspace."""
    m = tables.memories(s, d).drop("is_current", "stale")
    k = F.col("memory_id") % 20
    text = F.when(k == 3, F.lit(" \n ")).when(k == 4, F.lit(None).cast("string")).otherwise(F.col("text"))
    return m.withColumn("text", text).withColumn("metadata", F.when(k == 5, F.lit("{no")).when(k == 6, F.lit('{"a": 1}'))).withColumn("workspace_id", F.when(k != 7, F.col("workspace_id")))


def _no_vectors(s):
    return s.createDataFrame([], "key string, embedding array<double>")


def _zeros(texts):
    """Vectors whose only component tells a text's length: enough to follow them through."""
    return texts.select("key", F.array(F.length("text").cast("double")).alias("embedding"))


def _stored(s, d):
    return memory.add_memories(_rows_in(s, d), _no_vectors(s), _zeros, 1)


def _cached(s, d):
    """Half of the chunks' vectors are cached; what is left is embedded, each text once."""
    rows = tables.chunks(s, d)
    cache = rows.where("memory_id % 2 = 0").select(cache_key(F.col("text")).alias("key")).distinct().withColumn("embedding", F.array(F.lit(0.0)))
    out, new = memory.embedded(rows, _zeros, cache, 1)
    one = out.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding")[0] == 0).alias("from_cache"))
    return one.crossJoin(new.agg(F.count(F.lit(1)).alias("embedded")))


def _chunks_with_vectors(s, d):
    v = tables.vectors(s, d).select(F.col("chunk_id"), "embedding")
    texts = tables.read(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return v.join(texts, "chunk_id").select("chunk_id", F.col("chunk_id").alias("memory_id"), F.lit(0).cast("long").alias("chunk_index"), "text", "embedding")


def _found(s, d, mode):
    vector = list(tables.vectors(s, d).where("chunk_id = 7").first()["embedding"])
    got = memory.search_memory(tables.memories(s, d), _chunks_with_vectors(s, d), "with from this", ["with", "from", "this"], vector, 10, mode, "en", 0.05, index=_index(s, d), tags=["q0", "q1"])
    return got.select("memory_id", F.round("score", 6).alias("score"), "source", _text("created_at"), "chunk_index")


def _spaces(s, d):
    m = tables.memories(s, d)
    return m.groupBy("workspace_id").agg(F.min("created_at").alias("created_at")).select("workspace_id", F.upper("workspace_id").alias("name"), F.lit(None).cast("string").alias("description"), "created_at")


def _space_gone(s, d):
    w, m, c = memory.delete_workspace(_spaces(s, d), tables.memories(s, d), tables.chunks(s, d), "de", confirm=True)
    return lifecycle.global_stats(workspaces=w, memories=m, chunks=c)


def _pruned(s, d, part):
    after, report = memory.prune(tables.memories(s, d), tables.chunks(s, d), _entities_and_loose(s, d), tables.relationships(s, d), _mentions(s, d), dry_run=False, confirm=True)
    return report if part == "report" else lifecycle.global_stats(**after)


def _values(s, d):
    """A cache of events' values, each good for an hour from its time."""
    e = tables.read(s, d, "events")
    return e.select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("value").alias("value"), (F.col("ts") + F.expr("interval 1 hour")).alias("expires_at"))


def _now():
    return F.expr(f"timestamp_ntz'{T}'")


def _cache_after(s, d):
    c = _values(s, d)
    c = memory.cache_set(c, c.where("key like 'k1%'").select("key", F.lit(0.0).alias("value")), _now(), 600)
    return memory.cache_info(memory.cache_delete(c, c.where("key like 'k12%'")), _now())


QUERIES = {
    "filter_tags_any": lambda s, d: _m(s, d, tags=["q1", "de"]),
    "filter_source": lambda s, d: _m(s, d, source="src8"),
    "filter_date_range": lambda s, d: _m(s, d, since="2024-01-01 05:00:00", until="2024-01-01 09:30:00"),
    "filter_all": lambda s, d: _m(s, d, tags=["q0", "q1"], until="2024-01-01 12:00:00", workspace="en", current=True),
    "workspace_scan": lambda s, d: _m(s, d, workspace="fr"),
    "workspace_stats": lambda s, d: lifecycle.workspace_stats(tables.memories(s, d), tables.chunks(s, d)),
    "global_stats": lambda s, d: lifecycle.global_stats(memories=tables.memories(s, d), chunks=tables.chunks(s, d), entities=tables.entities(s, d), relationships=tables.relationships(s, d)),
    "label_counts_rollup": lambda s, d: lifecycle.label_counts(tables.entities(s, d), "type"),
    "asof_valid": lambda s, d: temporal.as_of(_ver(s, d), T).select("file_path", *_V),
    "asof_transaction": lambda s, d: temporal.as_of(_ver(s, d), T, "transaction").select("file_path", *_V),
    "asof_both": lambda s, d: temporal.as_of(_ver(s, d), T, "both").select("file_path", *_V),
    "asof_many_probes": lambda s, d: temporal.as_of_many(_ver(s, d), _probes(s, d)).withColumns({c: F.col(c).cast("string") for c in _V}),
    "history_by_file": lambda s, d: temporal.history(_ver(s, d), "/src/2/user7.py", limit=50).select(*_V, _text("valid_from")),
    "history_by_id": lambda s, d: temporal.history(_ver(s, d), memory_id=40).select(*_V),
    "version_chain": lambda s, d: temporal.version_chain(_ver(s, d), _first(s, d)),
    "changes_feed": lambda s, d: temporal.changes(_ver(s, d), "2024-01-10", "2024-01-20", prefix="/src/3/", limit=200).select(*_V, "change_type"),
    "changes_deleted": lambda s, d: temporal.changes(_ver(s, d), kind="deleted", limit=None).select(*_V, "change_type"),
    "changes_created": lambda s, d: temporal.changes(_ver(s, d), kind="created", limit=None).select(*_V, "change_type"),
    "close_version": lambda s, d: _shape(temporal.close_version(_ver(s, d), _first(s, d), T)),
    "new_version": lambda s, d: _shape(temporal.new_version(_ver(s, d), _first(s, d), -1, T, value=F.lit(1.0))),
    "soft_delete": lambda s, d: _shape(temporal.soft_delete(_ver(s, d), _first(s, d), T)),
    "migrate_bitemporal": lambda s, d: temporal.migrate(_bare(s, d)).select("memory_id", "version", "is_current", _text("valid_from"), F.col("valid_to").isNull().alias("open")),
    "migration_status": lambda s, d: temporal.migration_status(temporal.migrate(_bare(s, d).where("memory_id % 4 <> 0")).unionByName(temporal.migrate(_bare(s, d)).where("memory_id % 4 = 0").withColumn("valid_from", F.lit(None).cast("timestamp_ntz")))),
    "migrate_workspace": lambda s, d: temporal.migrate_workspace(_bare(s, d)).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")),
    "stale_preview": lambda s, d: lifecycle.stale_preview(tables.memories(s, d), tables.chunks(s, d), None),
    "stale_counts": lambda s, d: lifecycle.stale_counts(tables.memories(s, d), tables.chunks(s, d)),
    "stale_delete": lambda s, d: lifecycle.without(tables.chunks(s, d), tables.memories(s, d).where("stale")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")),
    "stale_snapshot": lambda s, d: lifecycle.stale_by_snapshot(tables.memories(s, d), tables.read(s, d, "labels").select(F.col("doc_id").alias("memory_id"))).select("memory_id", "stale"),
    "mark_stale_and_fresh": lambda s, d: lifecycle.mark_fresh(lifecycle.mark_stale(tables.memories(s, d), F.col("source") == "src1"), F.col("workspace_id") == "en").groupBy("stale").agg(F.count(F.lit(1)).alias("n")),
    "orphan_chunks": lambda s, d: lifecycle.orphan_chunks(tables.chunks(s, d), tables.memories(s, d)).select("memory_id", "chunk_index", F.length("text").cast("long").alias("n_chars")),
    "orphan_entities": lambda s, d: lifecycle.orphan_entities(_entities_and_loose(s, d), tables.relationships(s, d), _mentions(s, d)).select("id", "type"),
    "prune_all_preview": lambda s, d: lifecycle.prune_preview(tables.memories(s, d), tables.chunks(s, d), _entities_and_loose(s, d), tables.relationships(s, d), _mentions(s, d)),
    "delete_memory": lambda s, d: lifecycle.delete_memory(tables.memories(s, d), tables.chunks(s, d), 7, "en")[0].select("memory_id"),
    "clear_workspace": lambda s, d: lifecycle.clear_workspace(tables.memories(s, d), tables.chunks(s, d), "de", confirm=True)[0].groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")),
    "clear_workspace_chunks": lambda s, d: lifecycle.clear_workspace(tables.memories(s, d), tables.chunks(s, d), "de", confirm=True)[1].agg(F.count(F.lit(1)).alias("n")),
    "latency_percentiles": lambda s, d: monitor.percentiles(tables.ops(s, d)),
    "latency_rollup": lambda s, d: monitor.rollup(tables.ops(s, d)),
    "ops_last_n": lambda s, d: graph.latest(tables.ops(s, d), ["operation"], ["ts", "op_id"], 10).select("op_id", "operation"),
    "events_tumbling": lambda s, d: windows.tumbling(tables.read(s, d, "events")).select(_text("start"), "event_type", "n", "total"),
    "events_sliding": lambda s, d: windows.tumbling(tables.read(s, d, "events"), "1 hour", "30 minutes").select(_text("start"), "event_type", "n", "total"),
    "events_session": lambda s, d: windows.sessions(tables.read(s, d, "events"), "3 hours").select("user_id", _text("start"), "n"),
    "add_memory": lambda s, d: _stored(s, d).memories.select("memory_id", "n_chunks", "workspace_id", "version", "is_current", _text("valid_from")),
    "add_memory_chunks": lambda s, d: _stored(s, d).chunks.select("chunk_id", "chunk_index", F.sha2("text", 256).alias("digest"), "workspace_id"),
    "add_memory_rejected": lambda s, d: _stored(s, d).rejected,
    "embed_look_aside": _cached,
    "tool_search_end_to_end": lambda s, d: _found(s, d, "vector"),
    "tool_search_bm25": lambda s, d: _found(s, d, "bm25"),
    "tool_search_hybrid": lambda s, d: _found(s, d, "hybrid"),
    "tool_search_graph": lambda s, d: _found(s, d, "graph"),
    "ad_hoc_query": lambda s, d: memory.ad_hoc(s, "SELECT source, count(*) AS n FROM {m} WHERE workspace_id = :w GROUP BY source", {"w": "en"}, m=tables.memories(s, d)),
    "workspace_create_list": lambda s, d: memory.list_workspaces(memory.create_workspace(_spaces(s, d), "new-1", "New", T)).select("workspace_id", "name", _text("created_at")),
    "workspace_delete": _space_gone,
    "prune_report": lambda s, d: _pruned(s, d, "report"),
    "prune_delete": lambda s, d: _pruned(s, d, "after"),
    "cache_scan": lambda s, d: memory.cache_scan(_values(s, d), _now(), "k?5*"),
    "cache_set_delete_info": _cache_after,
    "graph_build_entities": lambda s, d: memory.build_graph(tables.read(s, d, "documents"))[0].select("name", "mentions", F.round("confidence", 6).alias("confidence")),
    "graph_build_edges": lambda s, d: memory.build_graph(tables.read(s, d, "documents"))[1].select("src", "dst", F.round("strength", 6).alias("strength"), "n"),
    "stats_summary": lambda s, d: monitor.summary(tables.ops(s, d)).withColumn("operation", F.coalesce("operation", F.lit("all"))),
    "latency_windows": lambda s, d: windows.latency(tables.ops(s, d)).select(_text("start"), "operation", "n", "low", "high", "mean"),
    "sessions_expired": lambda s, d: windows.expired_sessions(tables.read(s, d, "events"), "13 days", T).groupBy("expired").agg(F.count(F.lit(1)).alias("n")),
    "change_feed_rows": lambda s, d: windows.change_feed(_ver(s, d), "2024-01-10", prefix="/src/3/").select(*_V, "change_type"),
    "migration_dry_run": lambda s, d: temporal.migrate_dry_run(_bare(s, d)),
    "ingest_turns": lambda s, d: windows.ingest(tables.read(s, d, "conversations")),
}

MEM = "memories AS (SELECT d.doc_id AS memory_id, d.text, d.source, d.lang AS workspace_id, l.quality AS q, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at, d.doc_id % 7 = 0 AS stale FROM documents d LEFT JOIN labels l USING (doc_id))"
CHUNKS = """c0 AS (SELECT doc_id AS memory_id, unnest(range(0, greatest(ceil((length(text) - 512) / 462.0), 0)::BIGINT + 1)) AS chunk_index, text FROM documents WHERE length(text) > 0),
c1 AS (SELECT memory_id, chunk_index, chunk_index * 462 AS start, substring(text, (chunk_index * 462 + 1)::INT, 512) AS text FROM c0),
chunks AS (SELECT * FROM c1 UNION ALL SELECT memory_id + 1000000, chunk_index, start, text FROM c1 WHERE memory_id % 50 = 0)"""
ENT = """entities AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'GPE' AS type, (r_regionkey % 10 + 1) / 10 AS confidence FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'GPE', (n_nationkey % 10 + 1) / 10 FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'ORG', (s_suppkey % 10 + 1) / 10 FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, 'PERSON', (c_custkey % 10 + 1) / 10 FROM customer),
relationships AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS type, 0.9::DOUBLE AS strength FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', (s_suppkey % 10 + 1) / 10 FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN', (c_custkey % 10 + 1) / 10 FROM customer)"""
VER = """v0 AS (SELECT event_id AS memory_id, '/src/' || (user_id % 5) || '/user' || user_id || '.py' AS file_path, row_number() OVER w AS version, ts AS valid_from, lead(ts) OVER w AS valid_to, ts + INTERVAL 1 HOUR AS created_at, lead(ts) OVER w + INTERVAL 1 HOUR AS tt, lag(event_id) OVER w AS previous_version_id, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v1 AS (SELECT *, valid_to IS NULL AND event_type = 'purchase' AS gone FROM v0),
versions AS (SELECT * EXCLUDE (tt, gone), CASE WHEN gone THEN created_at + INTERVAL 1 HOUR ELSE tt END AS transaction_to, valid_to IS NULL AND NOT gone AS is_current FROM v1)"""
_F = "%Y-%m-%d %H:%M:%S"
_ALIVE_V = f"valid_from <= TIMESTAMP '{T}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T}')"
_ALIVE_T = f"created_at <= TIMESTAMP '{T}' AND (transaction_to IS NULL OR transaction_to > TIMESTAMP '{T}')"
_CHANGE = "CASE WHEN version = 1 THEN 'created' WHEN transaction_to IS NOT NULL AND NOT is_current THEN 'deleted' ELSE 'modified' END AS change_type"
_ONE = "file_path = '/src/2/user7.py'"


def _asof(cond):
    return f"WITH {VER} SELECT file_path, memory_id, version FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY version DESC, valid_from DESC) AS r FROM versions WHERE {cond}) WHERE r = 1"


def _edited(valid, transaction, current, more=""):
    own = f"{_ONE} AND version = 3"
    return f"""WITH {VER} SELECT memory_id, version, CASE WHEN {own} THEN {current} ELSE is_current END AS is_current, strftime(CASE WHEN {own} THEN {valid} ELSE valid_to END, '{_F}') AS valid_to, strftime(CASE WHEN {own} THEN {transaction} ELSE transaction_to END, '{_F}') AS transaction_to FROM versions WHERE {_ONE}{more}"""


_LOOSE = "ent2 AS (SELECT id, type FROM entities UNION ALL SELECT 'x' || id, type FROM entities WHERE type = 'GPE'), men AS (SELECT DISTINCT id FROM (SELECT unnest(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')) AS word FROM pages) p JOIN entities e ON lower(e.name) = p.word), orphans AS (SELECT id, type FROM ent2 WHERE id NOT IN (SELECT src FROM relationships UNION SELECT dst FROM relationships UNION SELECT id FROM men))"


def _mem(where):
    return f"WITH {MEM} SELECT memory_id, source, workspace_id FROM memories WHERE {where}"


def _pct(p):
    at = f"({p} * (n + 1))"
    low = f"greatest(least(floor({at}), n - 1), 1)::BIGINT"
    return f"round(CASE WHEN n = 1 THEN a[1] ELSE a[{low}] + ({at} - {low}) * (a[{low} + 1] - a[{low}]) END, 6)"


_IN = """rows_in AS (SELECT doc_id AS memory_id, CASE doc_id % 20 WHEN 3 THEN ' ' WHEN 4 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 20 = 7 THEN 'default' ELSE lang END AS workspace_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM documents),
w_in AS (SELECT *, greatest(ceil((length(text) - 512) / 462.0), 0)::BIGINT + 1 AS n_windows FROM rows_in WHERE memory_id % 20 NOT IN (3, 4, 5) AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
ok AS (SELECT *, n_windows - (n_windows > 1 AND length(text) - (n_windows - 1) * 462 < 100)::BIGINT AS n_chunks FROM w_in)"""
_FOUND = f"""{MEM}, {BM25}, v0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
live AS (SELECT memory_id AS id FROM memories WHERE workspace_id = 'en' AND q IN (0, 1)), chunked AS (SELECT id FROM live JOIN v0 USING (id)),
vec AS (SELECT a.id, round(list_cosine_similarity(a.e, q.e), 12) AS score FROM v0 a JOIN chunked USING (id), v0 q WHERE q.id = 7 AND list_cosine_similarity(a.e, q.e) >= 0.05 ORDER BY score DESC, a.id LIMIT 50),
word AS (SELECT doc_id AS id, score FROM all_hits WHERE doc_id IN (SELECT id FROM chunked) ORDER BY score DESC, doc_id LIMIT 50)"""
_RESULT = f"SELECT memory_id, round(f.score, 6) AS score, source, strftime(created_at, '{_F}') AS created_at, 0::BIGINT AS chunk_index FROM {{}} f JOIN memories m ON m.memory_id = f.id ORDER BY round(f.score, 12) DESC, memory_id LIMIT 10"
_NAMED = "named AS (SELECT doc_id, entity AS name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1)) AS entity FROM documents) GROUP BY 1, 2)"

SQL = {
    "filter_tags_any": _mem("workspace_id = 'de' OR coalesce(q = 1, FALSE)"),
    "filter_source": _mem("source = 'src8'"),
    "filter_date_range": _mem("created_at BETWEEN TIMESTAMP '2024-01-01 05:00:00' AND TIMESTAMP '2024-01-01 09:30:00'"),
    "filter_all": _mem("q IN (0, 1) AND created_at <= TIMESTAMP '2024-01-01 12:00:00' AND workspace_id = 'en'"),
    "workspace_scan": _mem("workspace_id = 'fr'"),
    "workspace_stats": f"WITH {MEM}, {CHUNKS}, p AS (SELECT memory_id, count(*) AS c FROM chunks GROUP BY memory_id) SELECT workspace_id, count(*) AS memories, coalesce(sum(c), 0)::BIGINT AS chunks, round(coalesce(sum(c), 0) / count(*), 6) AS mean_chunks FROM memories LEFT JOIN p USING (memory_id) GROUP BY workspace_id",
    "global_stats": f"WITH {MEM}, {CHUNKS}, {ENT} SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relationships) AS relationships",
    "label_counts_rollup": f"WITH {ENT} SELECT type, count(*) AS n FROM entities GROUP BY ROLLUP (type)",
    "asof_valid": _asof(_ALIVE_V),
    "asof_transaction": _asof(_ALIVE_T),
    "asof_both": _asof(f"{_ALIVE_V} AND {_ALIVE_T}"),
    "asof_many_probes": f"WITH {VER}, p AS (SELECT o_orderkey AS probe_id, '/src/' || (o_custkey % 150 % 5) || '/user' || (o_custkey % 150) || '.py' AS file_path, TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 700) AS t FROM orders), j AS (SELECT probe_id, p.file_path, memory_id, version, row_number() OVER (PARTITION BY probe_id ORDER BY version DESC) AS r FROM p LEFT JOIN versions v ON v.file_path = p.file_path AND valid_from <= t AND (valid_to IS NULL OR valid_to > t)) SELECT probe_id, file_path, memory_id::VARCHAR AS memory_id, version::VARCHAR AS version FROM j WHERE r = 1",
    "history_by_file": f"WITH {VER} SELECT memory_id, version, strftime(valid_from, '{_F}') AS valid_from FROM versions WHERE {_ONE} ORDER BY versions.valid_from DESC, memory_id DESC LIMIT 50",
    "history_by_id": f"WITH {VER} SELECT memory_id, version FROM versions WHERE memory_id = 40",
    "version_chain": f"WITH {VER}, top AS (SELECT version AS v FROM versions WHERE {_ONE} AND version = 3) SELECT memory_id, version, v - version AS depth FROM versions, top WHERE {_ONE} AND version <= v",
    "changes_feed": f"WITH {VER} SELECT memory_id, version, {_CHANGE} FROM versions WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20' AND file_path LIKE '/src/3/%' ORDER BY created_at DESC, memory_id DESC LIMIT 200",
    "changes_deleted": f"WITH {VER} SELECT memory_id, version, {_CHANGE} FROM versions WHERE transaction_to IS NOT NULL",
    "changes_created": f"WITH {VER} SELECT memory_id, version, {_CHANGE} FROM versions WHERE version = 1",
    "close_version": _edited(f"TIMESTAMP '{T}'", f"TIMESTAMP '{T}'", "FALSE"),
    "new_version": _edited(f"TIMESTAMP '{T}'", f"TIMESTAMP '{T}'", "FALSE", f" UNION ALL SELECT -1, 4, TRUE, NULL, NULL FROM versions WHERE {_ONE} AND version = 3"),
    "soft_delete": _edited("valid_to", f"TIMESTAMP '{T}'", "FALSE"),
    "migrate_bitemporal": f"WITH {MEM} SELECT memory_id, 1::BIGINT AS version, TRUE AS is_current, strftime(created_at, '{_F}') AS valid_from, TRUE AS open FROM memories",
    "migration_status": "SELECT count(*) AS total, count(*) FILTER (doc_id % 4 <> 0) AS migrated, count(*) FILTER (doc_id % 4 = 0) AS pending FROM documents",
    "migration_dry_run": "SELECT unnest(['version', 'is_current', 'valid_from']) AS change, count(*) AS n FROM documents",
    "add_memory": f"WITH {_IN} SELECT memory_id, n_chunks, workspace_id, 1::BIGINT AS version, TRUE AS is_current, strftime(created_at, '{_F}') AS valid_from FROM ok WHERE n_chunks <= 100",
    "add_memory_chunks": f"WITH {_IN}, e AS (SELECT *, unnest(range(n_chunks)) AS chunk_index FROM ok WHERE n_chunks <= 100) SELECT memory_id || ':' || chunk_index AS chunk_id, chunk_index, sha256(CASE WHEN chunk_index = n_chunks - 1 AND n_windows > n_chunks THEN substring(text, (chunk_index * 462 + 1)::INT, 512) || substring(text, (n_chunks * 462 + 1)::INT) ELSE substring(text, (chunk_index * 462 + 1)::INT, 512) END) AS digest, workspace_id FROM e",
    "add_memory_rejected": f"WITH {_IN} SELECT memory_id, CASE memory_id % 20 WHEN 4 THEN 'null' WHEN 3 THEN 'blank' WHEN 5 THEN 'metadata not JSON' END AS reason FROM rows_in WHERE memory_id % 20 IN (3, 4, 5) UNION ALL SELECT memory_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'blank' ELSE 'too many chunks' END FROM rows_in WHERE memory_id % 20 NOT IN (3, 4, 5) AND (trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' OR memory_id IN (SELECT memory_id FROM ok WHERE n_chunks > 100))",
    "embed_look_aside": f"WITH {CHUNKS}, k AS (SELECT memory_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key FROM chunks), c AS (SELECT DISTINCT key FROM k WHERE memory_id % 2 = 0) SELECT count(*) AS chunks, count(*) FILTER (key IN (SELECT key FROM c)) AS from_cache, count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM c)) AS embedded FROM k",
    "tool_search_end_to_end": f"WITH {_FOUND} {_RESULT.format('vec')}",
    "tool_search_bm25": f"WITH {_FOUND} {_RESULT.format('word')}",
    "tool_search_hybrid": f"WITH {_FOUND}, vr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM vec), wr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM word), both_ AS (SELECT coalesce(vr.id, wr.id) AS id, coalesce(0.5 / (60 + vr.r), 0) + coalesce(0.5 / (60 + wr.r), 0) AS score FROM vr FULL JOIN wr ON vr.id = wr.id) {_RESULT.format('both_')}",
    "ad_hoc_query": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source",
    "workspace_create_list": f"SELECT lang AS workspace_id, upper(lang) AS name, strftime(TIMESTAMP '2024-01-01' + to_minutes(min(doc_id)), '{_F}') AS created_at FROM documents GROUP BY lang UNION ALL SELECT 'new-1', 'New', '{T}'",
    "workspace_delete": f"WITH {MEM}, {CHUNKS} SELECT (SELECT count(DISTINCT lang) - 1 FROM documents) AS workspaces, (SELECT count(*) FROM memories WHERE workspace_id <> 'de') AS memories, (SELECT count(*) FROM chunks WHERE memory_id NOT IN (SELECT memory_id FROM memories WHERE workspace_id = 'de')) AS chunks",
    "prune_report": f"WITH {MEM}, {CHUNKS}, {ENT}, {_LOOSE} SELECT 'stale_code' AS what, count(*) AS n FROM memories WHERE stale UNION ALL SELECT 'stale_chunks', count(*) FROM chunks WHERE memory_id IN (SELECT memory_id FROM memories WHERE stale) UNION ALL SELECT 'orphaned_chunks', count(*) FROM chunks WHERE memory_id >= 1000000 UNION ALL SELECT 'orphaned_entities', count(*) FROM orphans",
    "prune_delete": f"WITH {MEM}, {CHUNKS}, {ENT}, {_LOOSE} SELECT (SELECT count(*) FROM memories WHERE NOT stale) AS memories, (SELECT count(*) FROM chunks WHERE memory_id IN (SELECT memory_id FROM memories WHERE NOT stale)) AS chunks, (SELECT count(*) FROM ent2) - (SELECT count(*) FROM orphans) AS entities",
    "cache_scan": f"SELECT 'k' || event_id AS key FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '{T}' AND regexp_matches('k' || event_id, '^k.5')",
    "cache_set_delete_info": f"SELECT count(*) AS keys, count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS expired FROM (SELECT starts_with(event_id::VARCHAR, '1') OR ts + INTERVAL 1 HOUR > TIMESTAMP '{T}' AS live FROM events WHERE NOT starts_with(event_id::VARCHAR, '12'))",
    "graph_build_entities": f"WITH {_NAMED} SELECT name, sum(n)::BIGINT AS mentions, round(1 - 0.15 / count(*), 6) AS confidence FROM named GROUP BY name",
    "graph_build_edges": f"WITH {_NAMED}, p AS (SELECT name, count(*) AS texts FROM named GROUP BY name), e AS (SELECT a.name AS src, b.name AS dst, count(*) AS n FROM named a JOIN named b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 2) SELECT src, dst, round(n / least(x.texts, y.texts), 6) AS strength, n FROM e JOIN p x ON x.name = src JOIN p y ON y.name = dst",
    "stats_summary": "WITH o AS (SELECT event_type AS operation, value, ts FROM events) SELECT coalesce(operation, 'all') AS operation, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) / (SELECT count(*) FROM o), 6) AS share, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS uptime FROM o GROUP BY ROLLUP (operation)",
    "latency_windows": f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '{_F}') AS start, event_type AS operation, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "sessions_expired": f"SELECT expired, count(*) AS n FROM (SELECT user_id, min(ts) + INTERVAL 13 DAY <= TIMESTAMP '{T}' AS expired FROM events GROUP BY 1) GROUP BY 1",
    "change_feed_rows": f"WITH {VER} SELECT memory_id, version, {_CHANGE} FROM versions WHERE created_at >= TIMESTAMP '2024-01-10' AND file_path LIKE '/src/3/%'",
    "migrate_workspace": f"WITH {MEM} SELECT CASE WHEN memory_id % 3 = 0 THEN 'default' ELSE workspace_id END AS workspace_id, count(*) AS n FROM memories GROUP BY 1",
    "stale_preview": f"WITH {MEM}, {CHUNKS} SELECT m.memory_id, count(c.memory_id) AS n_chunks FROM memories m LEFT JOIN chunks c ON c.memory_id = m.memory_id WHERE stale GROUP BY m.memory_id",
    "stale_counts": f"WITH {MEM}, {CHUNKS} SELECT count(DISTINCT m.memory_id) AS memories, count(c.memory_id) AS chunks FROM memories m LEFT JOIN chunks c ON c.memory_id = m.memory_id WHERE stale",
    "stale_delete": f"WITH {MEM}, {CHUNKS} SELECT memory_id, count(*) AS n FROM chunks WHERE memory_id NOT IN (SELECT memory_id FROM memories WHERE stale) GROUP BY memory_id",
    "stale_snapshot": f"WITH {MEM} SELECT memory_id, memory_id NOT IN (SELECT doc_id FROM labels) AS stale FROM memories",
    "mark_stale_and_fresh": f"WITH {MEM} SELECT (stale OR source = 'src1') AND workspace_id <> 'en' AS stale, count(*) AS n FROM memories GROUP BY 1",
    "orphan_chunks": f"WITH {MEM}, {CHUNKS} SELECT memory_id, chunk_index, length(text) AS n_chars FROM chunks WHERE memory_id NOT IN (SELECT memory_id FROM memories)",
    "orphan_entities": f"WITH {ENT}, {_LOOSE} SELECT id, type FROM orphans",
    "prune_all_preview": f"WITH {MEM}, {CHUNKS}, {ENT}, {_LOOSE} SELECT * FROM (SELECT 'stale_code' AS what, memory_id::VARCHAR AS id FROM memories WHERE stale ORDER BY memory_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'orphaned_chunks', memory_id || ':' || chunk_index FROM chunks WHERE memory_id NOT IN (SELECT memory_id FROM memories) ORDER BY memory_id, chunk_index LIMIT 5) UNION ALL SELECT * FROM (SELECT 'orphaned_entities', id FROM orphans ORDER BY id LIMIT 5)",
    "delete_memory": f"WITH {MEM} SELECT memory_id FROM memories WHERE NOT (memory_id = 7 AND workspace_id = 'en')",
    "clear_workspace": f"WITH {MEM} SELECT workspace_id, count(*) AS n FROM memories WHERE workspace_id IS DISTINCT FROM 'de' GROUP BY 1",
    "clear_workspace_chunks": f"WITH {MEM}, {CHUNKS} SELECT count(*) AS n FROM chunks WHERE memory_id NOT IN (SELECT memory_id FROM memories WHERE workspace_id = 'de')",
    "latency_percentiles": f"WITH a AS (SELECT event_type AS operation, list(value ORDER BY value) AS a, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT operation, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95, {_pct(0.99)} AS p99 FROM a",
    "latency_rollup": "SELECT event_type AS operation, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS throughput FROM events GROUP BY 1",
    "ops_last_n": "SELECT event_id AS op_id, event_type AS operation FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10",
    "events_tumbling": f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '{_F}') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": f"WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) SELECT strftime(s, '{_F}') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
    "events_session": f"WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '{_F}') AS start, count(*) AS n FROM k GROUP BY user_id, s",
    "ingest_turns": "SELECT DISTINCT sha256(conv_id || '|' || turn) AS memory_id, 'conv' || conv_id AS source, role, text FROM conversations WHERE trim(text) <> ''",
}
