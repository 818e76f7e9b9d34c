"""The pipeline: documents to mixed token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from engram.llm import decontamination, mixing, near_dedup, token_output, toxicity
from engram.llm.common import discard, documents, remove, work_dir, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on the labelled among them."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by 0.8 of their five-word shingles."""
    return near_dedup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages of eight words or more; those that are mostly benchmark go."""
    return decontamination.remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in segments, read back: a row for each document in the written order."""
    import public_tokenizers

    return token_output.read_segments(token_output.write_segments(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: A model, hash orders and a tokenizer decide on rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder. What a stage has read is removed once its own rows are written."""
    docs, top = documents(spark, sf_dir), f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        since = written(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        discard(spark, since)
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            remove(spark, f"{top}/{before}")
        before = name
    return docs
