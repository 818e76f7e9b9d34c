"""Operator 8: token counts through a cache keyed by digests of content and tokenizer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import documents, scratch, ship, small_batches, table, text_bytes, work_dir
from engram.llm.tokens import byte_tokens, file_digest, unusual_space

_CACHE = "content binary, tokenizer string, n_tokens long"
#: Digests that may be broadcast, some 40 MB; more are joined by a shuffle of the texts.
MOST_BROADCAST = 500_000


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """content, n_tokens of a tokenizer version; a count that was appended twice, as after a lost task, counts once."""
    try:
        have = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], _CACHE)
    return have.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text).

    Content is normalised as far as no count can change: null is the empty text. Its SHA-256 and that of the
    tokenizer's file are the key. Digests alone are joined with cache (a folder that all machines share) and reduced to
    the distinct misses, each with the smallest id that has it; then the texts of these rows are fetched and encoded,
    and their counts appended. So a text is encoded once, however many ids have it (rows equal in id and text are
    encoded each, and count once). The tokenizer is a byte-level one of the tokenizers library; executors read it at
    this path. An empty table gives no rows and leaves the cache as it is.
    """
    spark = docs.sparkSession
    ship(spark)
    version = file_digest(tokenizer)
    text = F.coalesce("text", F.lit(""))
    content = F.unhex(F.sha2(text, 256))
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    with scratch(spark) as keep:
        keyed = keep(table(keyed, "digests"))
        owner = F.coalesce("doc_id", F.lit(-(2**63))).alias("owner")
        misses = keyed.select("content", owner).groupBy("content").agg(F.min("owner").alias("owner")).join(cached_counts(spark, cache, version), "content", "left_anti")
        misses = table(misses, "misses")
        few = misses.count() <= most_broadcast
        once = docs.select(text.alias("text"), content.alias("content"), owner).join(F.broadcast(misses) if few else misses, ["content", "owner"], "left_semi").select("content", "text")
        _encode(once, tokenizer, version).write.mode("append").parquet(cache)
    return keyed.join(cached_counts(spark, cache, version), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _encode(texts: DataFrame, tokenizer: str, version: str) -> DataFrame:
    fields = pa.schema([("content", pa.binary()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_tokens(tokenizer)
        for b in small_batches(batches, "text"):
            odd = unusual_space(*text_bytes(b.column(1))).tolist()
            n = [coder.count(t, o) for t, o in zip(b.column(1).to_pylist(), odd, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n)), pa.array(n, pa.int64())], schema=fields)

    return texts.mapInArrow(run, _CACHE)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # A new cache each time: the query encodes every distinct text.
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), f"{work_dir(spark)}/token_counts-{uuid.uuid4().hex}")
