"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.llm import decontamination, embedding_dedup, mixing, near_dedup, oracles, pii, substring_dedup, token_counts, token_output, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_pii": pii.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_near_dedup": near_dedup.query,
        "op5_url_filter": url_filter.query,
        "op6_embedding_dedup": embedding_dedup.query,
        "op7_decontamination": decontamination.query,
        "op8_token_counts": token_counts.query,
        "op9_token_output": token_output.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op4_near_dedup": oracles.NEAR_DEDUP,
        "op5_url_filter": url_filter.SQL,
        "op6_embedding_dedup": oracles.EMBEDDING_DEDUP,
        "op7_decontamination": oracles.DECONTAMINATION,
    }
