"""Workspaces, stale and orphaned rows, deletions. Edits give the table as it is after; the caller writes it elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(tags: list[str] | None = None, source: str | None = None, since: str | None = None, until: str | None = None, workspace: str | None = None, current: bool | None = None) -> Column:
    """Rows of memories that fit all that is given: any of the tags, dates from since to until with both ends."""
    keep = F.lit(True)
    if tags is not None:
        keep &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    if source is not None:
        keep &= F.col("source") == source
    if since is not None:
        keep &= F.col("created_at") >= F.lit(since).cast("timestamp_ntz")
    if until is not None:
        keep &= F.col("created_at") <= F.lit(until).cast("timestamp_ntz")
    if workspace is not None:
        keep &= F.col("workspace_id") == workspace
    if current is not None:
        keep &= F.col("is_current") == current
    return keep


def workspace_stats(memories: DataFrame, chunks: DataFrame) -> DataFrame:
    """workspace_id, memories, chunks, mean_chunks; both sides are summed before they meet."""
    per = chunks.groupBy("memory_id").agg(F.count(F.lit(1)).alias("c"))
    s = memories.select("workspace_id", "memory_id").join(per, "memory_id", "left").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("memories"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"))
    return s.withColumn("mean_chunks", F.round(F.col("chunks") / F.col("memories"), 6))


def global_stats(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table by name; 0 where one is empty."""
    one = [t.agg(F.count(F.lit(1)).alias(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), one)


def label_counts(nodes: DataFrame, label: str) -> DataFrame:
    """label, n for each and, under null, for all."""
    return nodes.rollup(label).agg(F.count(F.lit(1)).alias("n"))


def stale_preview(memories: DataFrame, chunks: DataFrame, limit: int | None = 10) -> DataFrame:
    """memory_id, n_chunks of stale memories; memories without chunks have 0."""
    gone = memories.where("stale").select("memory_id")
    per = chunks.join(gone, "memory_id", "left_semi").groupBy("memory_id").agg(F.count(F.lit(1)).alias("c"))
    out = gone.join(per, "memory_id", "left").select("memory_id", F.coalesce("c", F.lit(0)).alias("n_chunks")).orderBy("memory_id")
    return out if limit is None else out.limit(limit)


def stale_counts(memories: DataFrame, chunks: DataFrame) -> DataFrame:
    return stale_preview(memories, chunks, None).agg(F.count(F.lit(1)).alias("memories"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))


def mark_stale(memories: DataFrame, where: Column) -> DataFrame:
    return memories.withColumn("stale", F.col("stale") | where)


def mark_fresh(memories: DataFrame, where: Column) -> DataFrame:
    return memories.withColumn("stale", F.col("stale") & ~where)


def stale_by_snapshot(memories: DataFrame, scan: DataFrame, key: str = "memory_id") -> DataFrame:
    """memories with stale set where the current scan doesn't have the key any more."""
    seen = scan.select(key).distinct().withColumn("_seen", F.lit(True))
    return memories.join(seen, key, "left").withColumn("stale", F.col("_seen").isNull()).drop("_seen")


def without(df: DataFrame, gone: DataFrame, key: str = "memory_id") -> DataFrame:
    """df without the rows whose key is in gone."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def orphan_chunks(chunks: DataFrame, memories: DataFrame) -> DataFrame:
    return without(chunks, memories)


def orphan_entities(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that no mention names and no edge touches. mentions: entity_id."""
    used = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(mentions.select("entity_id"))
    return without(entities, used, "id")


def delete_memory(memories: DataFrame, chunks: DataFrame, memory_id: int, workspace: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a memory and its chunks; unchanged where it isn't in that workspace."""
    gone = memories.where((F.col("memory_id") == memory_id) & (F.col("workspace_id") == workspace))
    return without(memories, gone), without(chunks, gone)


def clear_workspace(memories: DataFrame, chunks: DataFrame, workspace: str, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    if not confirm:
        raise ValueError("confirm=True is needed")
    gone = memories.where(F.col("workspace_id") == workspace)
    return memories.where(~F.col("workspace_id").eqNullSafe(workspace)), without(chunks, gone)


def prune_preview(memories: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame, strategy: str = "all") -> DataFrame:
    """what, id of what a strategy would delete, a few of each kind: 10 stale, 5 orphaned chunks, 5 entities."""
    parts = {
        "stale_code": lambda: stale_preview(memories, chunks, 10).select(F.lit("stale_code").alias("what"), F.col("memory_id").cast("string").alias("id")),
        "orphaned_chunks": lambda: orphan_chunks(chunks, memories).orderBy("memory_id", "chunk_index").limit(5).select(F.lit("orphaned_chunks").alias("what"), F.concat_ws(":", "memory_id", "chunk_index").alias("id")),
        "orphaned_entities": lambda: orphan_entities(entities, edges, mentions).orderBy("id").limit(5).select(F.lit("orphaned_entities").alias("what"), "id"),
    }
    if strategy not in (*parts, "all"):
        raise ValueError(f"unknown strategy {strategy}")
    return reduce(DataFrame.unionByName, [p() for k, p in parts.items() if strategy in (k, "all")])


def cache_lookup(texts: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """texts with the cache's vectors where it has them, and the distinct keys that it lacks."""
    return texts.join(cache, key, "left"), texts.select(key).distinct().join(cache.select(key), key, "left_anti")


def hit_rate(looked_up: DataFrame, value: str) -> DataFrame:
    n, hits = F.count(F.lit(1)), F.count(value)
    return looked_up.agg(hits.alias("hits"), (n - hits).alias("misses"), F.round(F.when(n > 0, hits / n).otherwise(0.0), 6).alias("hit_rate"))


def validate(df: DataFrame, most: int = 10_000_000) -> DataFrame:
    """df with reason: null where a text may be stored, else why not."""
    bad = F.when(F.col("text").isNull(), "null").when(F.trim("text") == "", "blank").when(F.length("text") > most, "too long").when(F.contains("text", F.lit("\x01")), "control")
    return df.withColumn("reason", bad)
