"""A SparkSession with the settings that the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "engram", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; what conf names wins. master: as spark-submit gives it where None."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def tasks(spark: SparkSession) -> int:
    """Tasks that long work over few bytes is dealt to: splits by size would leave it to few of them."""
    return 4 * max(spark.sparkContext.defaultParallelism, 4)
