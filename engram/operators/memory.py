"""The whole path of a memory: validation, chunks, embeddings and storing; search; workspaces; pruning; the graph; caches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import cache_key, normalize_entity, tokenize
from engram.functions.vectors import hashing_embedding, padded, valid
from engram.operators import chunking, graph, lifecycle, search

#: Limits of requests.
MOST_TEXT, MOST_CHUNKS, MOST_METADATA, MOST_QUERY, MOST_RESULTS, MOST_STATEMENT, LEAST_TTL = 10_000_000, 100, 100 << 10, 1000, 100, 100_000, 60
DEFAULT_WORKSPACE = "default"
MODES = ("vector", "bm25", "hybrid", "graph")

# --- Embeddings and their cache -----------------------------------------------------------------------------------------


def embed_batches(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32, fallback: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """key, embedding of texts (key, text) by a model that takes at most batch texts at a time, on the executors.

    Where a batch fails its texts are tried one by one; those that fail alone go to fallback, whose vectors are filled
    up with zeros to dim. A text that nothing embeds has a null embedding.
    """
    if not 1 <= batch <= 64:
        raise ValueError("batch must be from 1 to 64")

    def one(text: str) -> list[float] | None:
        for f in (model, fallback):
            try:
                if f is not None:
                    v = f([text])[0]
                    return [*v, *[0.0] * (dim - len(v))]
            except Exception:  # noqa: BLE001, S112 - any failure of a model leads to the next
                continue
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                try:
                    vectors = model(texts)
                except Exception:  # noqa: BLE001
                    vectors = [one(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["key", "embedding"])

    return texts.select("key", "text").mapInArrow(run, "key string, embedding array<double>")


def hashed(texts: DataFrame, dim: int = 64) -> DataFrame:
    """key, embedding of texts (key, text) by token hashes: a stand-in for a model, in built-in expressions."""
    return texts.select("key", hashing_embedding(tokenize(F.col("text")), dim).alias("embedding"))


def embedded(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """texts (text, ...) with key and embedding: the cache's (key, embedding) where it has one, else embed's; and what is new.

    Only distinct missing keys are embedded. A vector that isn't of dim finite numbers is null.
    """
    keyed = texts.withColumn("key", cache_key(F.col("text")))
    once = keyed.groupBy("key").agg(F.min("text").alias("text"))
    missing = once.join(cache.select("key"), "key", "left_anti")
    new = embed(missing).select("key", padded(F.col("embedding"), dim).alias("embedding"))
    new = new.select("key", F.when(valid(F.col("embedding"), dim), F.col("embedding")).alias("embedding"))
    known = cache.select("key", "embedding").unionByName(new)
    return keyed.join(known, "key", "left"), new.where("embedding is not null")


def cache_set(cache: DataFrame, rows: DataFrame, now: Column, ttl: int) -> DataFrame:
    """cache (key, value, expires_at) with rows (key, value), which live for ttl seconds from now; a new value replaces an old one."""
    if ttl < LEAST_TTL:
        raise ValueError(f"ttl must be at least {LEAST_TTL}")
    new = rows.select("key", "value").dropDuplicates(["key"]).withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl)))
    return cache.join(new.select("key"), "key", "left_anti").select("key", "value", "expires_at").unionByName(new)


def cache_live(cache: DataFrame, now: Column) -> DataFrame:
    """Rows that haven't expired."""
    return cache.where(F.col("expires_at") > now)


def cache_delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def cache_scan(cache: DataFrame, now: Column, pattern: str = "*") -> DataFrame:
    """Keys that live and fit a pattern of * and ?."""
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return cache_live(cache, now).where(F.col("key").rlike(f"(?s)^{body}$")).select("key")


def cache_info(cache: DataFrame, now: Column) -> DataFrame:
    """keys, live, expired."""
    live = F.count_if(F.col("expires_at") > now)
    return cache.agg(F.count(F.lit(1)).alias("keys"), live.alias("live"), (F.count(F.lit(1)) - live).alias("expired"))


# --- Storing ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stored:
    """What storing gives: rows for the tables, and the rejected with a reason."""

    memories: DataFrame
    chunks: DataFrame
    rejected: DataFrame
    new_vectors: DataFrame


def refusal(most: int = MOST_TEXT) -> Column:
    """Why a row (text, metadata) isn't stored; null where it may be."""
    too_big = F.octet_length(F.coalesce("metadata", F.lit(""))) > MOST_METADATA
    return F.when(F.col("text").isNull(), "null").when(F.trim(F.regexp_replace("text", "\\s+", " ")) == "", "blank").when(F.length("text") > most, "too long").when(too_big, "metadata too large").when(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), "metadata not JSON")


def add_memories(rows: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame] = hashed, dim: int = 64, size: int = 512, overlap: int = 50, most_chunks: int = MOST_CHUNKS, most_text: int = MOST_TEXT) -> Stored:
    """Memories and chunks of rows (memory_id, text, source, tags, metadata, workspace_id, created_at).

    A row that isn't valid, or has more than most_chunks chunks, is rejected with its reason. Chunks are windows of
    characters, small ones merged; their vectors come from cache (key, embedding) or embed. A new memory is version 1,
    current and valid from its creation; a null workspace is the default.
    """
    rows = rows.withColumn("reason", refusal(most_text))
    ok = rows.where("reason is null")
    parts = chunking.fixed_chunks(ok, ["memory_id"], size, overlap).groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    whole = parts.select("memory_id", chunking.merge_small(F.col("c.text"), chunking.least_size(size)).alias("texts"))
    many = whole.where(F.size("texts") > most_chunks).select("memory_id", F.lit("too many chunks").alias("why"))
    rejected = rows.join(many, "memory_id", "left").withColumn("reason", F.coalesce("reason", "why")).where("reason is not null").select("memory_id", "reason")
    kept = whole.where(F.size("texts") <= most_chunks)
    chunks = kept.select("memory_id", F.posexplode("texts").alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    with_vectors, new = embedded(chunks, embed, cache, dim)
    space = F.coalesce("workspace_id", F.lit(DEFAULT_WORKSPACE))
    memories = ok.join(kept.select("memory_id", F.size("texts").cast("long").alias("n_chunks")), "memory_id").select(
        "memory_id", "text", "source", "tags", "metadata", space.alias("workspace_id"), "created_at", "n_chunks", F.lit(1).cast("long").alias("version"), F.lit(True).alias("is_current"),
        F.col("created_at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("timestamp_ntz").alias("transaction_to"), F.lit(False).alias("stale"),
    )
    out = with_vectors.join(memories.select("memory_id", "workspace_id"), "memory_id").select(F.concat_ws(":", "memory_id", "chunk_index").alias("chunk_id"), "memory_id", "chunk_index", "text", "embedding", "workspace_id")
    return Stored(memories, out, rejected, new)


# --- Search -------------------------------------------------------------------------------------------------------------


def search_memory(memories: DataFrame, chunks: DataFrame, query: str, terms: list[str], vector: list[float], limit: int = 10, mode: str = "vector", workspace: str | None = DEFAULT_WORKSPACE, least: float = 0.5, index: search.Index | None = None, **filters) -> DataFrame:
    """memory_id, text, score, tags, source, created_at, chunk_index of the best chunks, one of each memory.

    query is what was asked, terms and vector what tokenizer and model made of it. mode: vector (cosines of at least
    least), bm25, hybrid (both by reciprocal ranks), or graph (memories that share entities with the best vector hits).
    filters: see ``lifecycle.matches``; they and the workspace hold for every mode, before the best are taken. index: a
    written one of the chunks, whose ids are chunk ids; else one is made of the rows that fit.
    """
    if not 1 <= len(query) <= MOST_QUERY or not query.strip():
        raise ValueError(f"a query has from 1 to {MOST_QUERY} characters")
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must be from 1 to {MOST_RESULTS}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    kept = memories.where(lifecycle.matches(workspace=workspace, current=True, **filters)).select("memory_id", "tags", "source", "created_at")
    rows = chunks.select("chunk_id", "memory_id", "chunk_index", F.col("text").alias("chunk_text"), "embedding").join(kept.select("memory_id"), "memory_id", "left_semi")
    depth = limit * 5  # several chunks may be one memory's

    def by_vector(n: int) -> DataFrame:
        return search.knn(rows, vector, n, least).select(F.col("chunk_id").alias("id"), F.col("similarity").alias("score"))

    def by_terms(n: int) -> DataFrame:
        made = index or search.indexed(rows.select("chunk_id", F.col("chunk_text").alias("text")), "chunk_id")
        among = rows.select(F.col("chunk_id").alias(made.id)) if index else None
        return search.bm25(made, terms, n, among=among).select(F.col(made.id).alias("id"), "score")

    if mode == "bm25":
        hits = by_terms(depth)
    elif mode == "hybrid":
        hits = search.best(search.rrf(by_vector(depth), by_terms(depth)).select("id", "score"), depth)
    else:
        hits = by_vector(depth)
    if mode == "graph":
        named = graph.capitalised_mentions(rows.select(F.col("chunk_id").alias("doc_id"), F.col("chunk_text").alias("text")))
        told = named.join(hits.select(F.col("id").alias("doc_id"), "score"), "doc_id").groupBy("entity").agg(F.max("score").alias("score"))
        more = named.join(told, "entity").groupBy(F.col("doc_id").alias("id")).agg(F.max("score").alias("score"))
        hits = hits.unionByName(more).groupBy("id").agg(F.max("score").alias("score"))
    found = rows.select(F.col("chunk_id").alias("id"), "memory_id", "chunk_index", "chunk_text").join(hits, "id")
    top = found.groupBy("memory_id").agg(F.max_by(F.struct("score", "chunk_index", F.col("chunk_text").alias("text")), F.struct(F.round("score", search.PLACES), -F.col("chunk_index"))).alias("b"))
    out = top.join(kept, "memory_id").select("memory_id", "b.text", "b.score", "tags", "source", "created_at", "b.chunk_index")
    return out.orderBy(search.first("score"), "memory_id").limit(limit)


def ad_hoc(spark: SparkSession, statement: str, params: dict | None = None, **views: DataFrame) -> DataFrame:
    """The rows of an SQL statement over views, which it names in braces, with named parameters."""
    if not statement.strip() or len(statement) > MOST_STATEMENT:
        raise ValueError(f"a statement has from 1 to {MOST_STATEMENT} characters")
    json.dumps(params or {})  # parameters are plain values
    return spark.sql(statement, args=params or None, **views)


# --- Workspaces and pruning ---------------------------------------------------------------------------------------------


def create_workspace(workspaces: DataFrame, workspace_id: str, name: str, created_at: str, description: str | None = None) -> DataFrame:
    """workspaces (workspace_id, name, description, created_at) with a new one; its id must be free."""
    if not re.fullmatch("[a-zA-Z0-9_-]+", workspace_id):
        raise ValueError("an id has letters, digits, _ and -")
    if not workspaces.where(F.col("workspace_id") == workspace_id).isEmpty():
        raise ValueError(f"workspace {workspace_id} exists")
    new = workspaces.sparkSession.range(1).select(F.lit(workspace_id).alias("workspace_id"), F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"), F.lit(created_at).cast("timestamp_ntz").alias("created_at"))
    return workspaces.unionByName(new)


def get_workspace(workspaces: DataFrame, workspace_id: str) -> DataFrame:
    return workspaces.where(F.col("workspace_id") == workspace_id)


def list_workspaces(workspaces: DataFrame) -> DataFrame:
    return workspaces.orderBy("created_at", "workspace_id")


def delete_workspace(workspaces: DataFrame, memories: DataFrame, chunks: DataFrame, workspace_id: str, confirm: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a workspace, its memories and their chunks; the default one stays."""
    if workspace_id == DEFAULT_WORKSPACE:
        raise ValueError("the default workspace can't be deleted")
    left, rest = lifecycle.clear_workspace(memories, chunks, workspace_id, confirm)
    return workspaces.where(F.col("workspace_id") != workspace_id), left, rest


STRATEGIES = ("stale_code", "orphaned_chunks", "orphaned_entities", "all")


def prune(memories: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame, strategy: str = "all", dry_run: bool = True, confirm: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a strategy (memories, chunks, entities), and what, n of the rows it deletes; none are with dry_run.

    Stale memories go with their chunks; then chunks without a memory and entities that nothing names or touches.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if not dry_run and not confirm:
        raise ValueError("confirm=True is needed")
    gone: dict[str, DataFrame] = {}
    if strategy in ("stale_code", "all"):
        stale = memories.where("stale").select("memory_id")
        gone["stale_code"] = stale
        gone["stale_chunks"] = chunks.join(stale, "memory_id", "left_semi")
    if strategy in ("orphaned_chunks", "all"):
        gone["orphaned_chunks"] = lifecycle.orphan_chunks(chunks, memories)
    if strategy in ("orphaned_entities", "all"):
        gone["orphaned_entities"] = lifecycle.orphan_entities(entities, edges, mentions)
    counts = [df.agg(F.lit(k).alias("what"), F.count(F.lit(1)).alias("n")) for k, df in gone.items()]
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    after = {"memories": memories, "chunks": chunks, "entities": entities}
    if not dry_run:
        if "stale_code" in gone:
            after["memories"] = lifecycle.without(memories, gone["stale_code"])
            after["chunks"] = lifecycle.without(after["chunks"], gone["stale_code"])
        if "orphaned_chunks" in gone:
            after["chunks"] = after["chunks"].join(memories.select("memory_id"), "memory_id", "left_semi").select(*chunks.columns)
        if "orphaned_entities" in gone:
            after["entities"] = lifecycle.without(entities, gone["orphaned_entities"], "id")
    return after, report


# --- The graph of texts -------------------------------------------------------------------------------------------------


def build_graph(docs: DataFrame, least_confidence: float = 0.7, least_shared: int = 2, id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (name, type, mentions, confidence), relationships (src, dst, type, strength, n) and one row of counts.

    Names are runs of capitalised words, a stand-in for a tagger, each in its normal form; an entity's confidence grows
    with the texts that name it, from 0.85 on a single one. Two entities are related by the share of the rarer one's
    texts that name both. Entities below least_confidence and pairs in fewer than least_shared texts are left out.
    """
    if not 0 <= least_confidence <= 1:
        raise ValueError("least_confidence must be from 0 to 1")
    named = graph.capitalised_mentions(docs, id).select(id, normalize_entity(F.col("entity"), F.lit("PERSON")).alias("name"), "n").groupBy(id, "name").agg(F.sum("n").alias("n"))
    per = named.groupBy("name").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("texts"))
    entities = per.select("name", F.lit("PERSON").alias("type"), "mentions", (1 - F.lit(0.15) / F.col("texts")).alias("confidence"), "texts").where(F.col("confidence") >= least_confidence)
    live = named.join(entities.select("name"), "name", "left_semi")
    pairs = graph.cooccurrence(live.select(F.col(id).alias("chunk_id"), F.col("name").alias("entity")), least_shared)
    ends = [entities.select(F.col("name").alias(c), F.col("texts").alias(f"{c}_texts")) for c in ("src", "dst")]
    edges = pairs.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", F.lit("RELATED_TO").alias("type"), (F.col("n") / F.least("src_texts", "dst_texts")).alias("strength"), "n")
    counts = entities.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")).crossJoin(edges.agg(F.count(F.lit(1)).alias("relationships")))
    return entities.drop("texts"), edges, counts
