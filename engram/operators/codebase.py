"""A codebase as memories: one for each function, class and remaining file, and what changes when it is scanned again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import code
from engram.sources import files as sources


def memories(files: DataFrame, workspace: str = "default") -> DataFrame:
    """memory_id, text, source, workspace_id, tags, file_path, qualified_name, first_line, last_line, digest.

    files: path, relative_path, text. A function's or class's text is its lines under a line that says what it is; a
    file without either is a memory as a whole. The id is a hash of workspace, path, name and line, the digest that of
    the text, so a second scan of the same file gives the same rows.
    """
    every = code.parts(files.select(F.col("relative_path").alias("path"), "text").where(F.trim("text") != ""))
    lang = sources.language("path")
    head = F.concat_ws(" ", F.lit("#"), F.col("kind"), F.col("qualified"), F.lit("in"), F.col("path"))
    text = F.concat_ws("\n", head, "doc", "body")
    key = F.sha2(F.concat_ws("|", F.lit(workspace), "path", F.coalesce("qualified", F.lit("")), "line"), 256)
    return every.select(
        key.alias("memory_id"), text.alias("text"), F.lit("code_indexer").alias("source"), F.lit(workspace).alias("workspace_id"), F.array(F.lit("code"), lang, F.col("kind")).alias("tags"),
        F.col("path").alias("file_path"), F.col("qualified").alias("qualified_name"), F.col("line").alias("first_line"), F.col("end_line").alias("last_line"), F.sha2(text, 256).alias("digest"),
    )


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """memory_id, change: added, changed (another digest), kept or stale (not in the scan any more)."""
    a, b = before.select("memory_id", F.col("digest").alias("was")), now.select("memory_id", F.col("digest").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "stale").when(F.col("was") == F.col("is"), "kept").otherwise("changed")
    return a.join(b, "memory_id", "full").select("memory_id", change.alias("change"))


def reindex(before: DataFrame, now: DataFrame) -> DataFrame:
    """The memories after a scan: those of now, not stale, and those that only before has, stale. Columns as now has them."""
    gone = before.select(*now.columns).join(now.select("memory_id"), "memory_id", "left_anti").select(*now.columns)
    return now.withColumn("stale", F.lit(False)).unionByName(gone.withColumn("stale", F.lit(True)))


def index(files: DataFrame, workspace: str = "default", languages: list[str] | None = None, most_bytes: int = sources.MOST_BYTES, tests: bool = False, ignore: list[str] = []) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B006
    """Memories, calls and symbols of files (relative_path, size, text) worth indexing."""
    kept = sources.keep(files, languages, most_bytes, tests, ignore)
    named = kept.select(F.col("relative_path").alias("path"), "text")
    return memories(kept, workspace), code.calls(named), code.symbols(named)
