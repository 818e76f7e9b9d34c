"""Latency figures of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_percentile(ordered: Column, p: float) -> Column:
    """Of a sorted array, by the exclusive method: place p * (n + 1), between neighbours by proportion."""
    n = F.size(ordered)
    at = F.lit(p) * (n + 1)
    low = F.greatest(F.least(F.floor(at), n - 1), F.lit(1)).cast("int")
    a = F.element_at(ordered, low)
    return F.when(n == 1, ordered[0]).when(n > 1, a + (at - low) * (F.element_at(ordered, low + 1) - a))


def percentiles(ops: DataFrame, by: str = "operation", value: str = "duration_ms") -> DataFrame:
    """by, p50, p95, p99 of each group by the exclusive method.

    Values are counted before they are gathered, so an array holds each distinct value once; the two ranks that a
    percentile needs come from running counts. Groups need not fit in a task.
    """
    c = ops.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    c = c.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    out = []
    for p in (0.5, 0.95, 0.99):
        at = F.lit(p) * (F.col("n") + 1)
        low = F.greatest(F.least(F.floor(at), F.col("n") - 1), F.lit(1))
        first = F.min(F.when(F.col("upto") >= low, F.col(value)))
        second = F.min(F.when(F.col("upto") >= F.least(low + 1, F.col("n")), F.col(value)))
        place = F.first(at - low)
        out.append(F.round(F.when(F.first("n") == 1, first).otherwise(first + place * (second - first)), 6).alias(f"p{round(p * 100)}"))
    return c.groupBy(by).agg(*out)


def rollup(ops: DataFrame, by: str = "operation", value: str = "duration_ms") -> DataFrame:
    """by, n, low, high, mean, throughput (operations a second between the first and the last; 0 without a span)."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    n = F.count(F.lit(1))
    return ops.groupBy(by).agg(n.alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"), F.round(F.when(span > 0, n / span).otherwise(0.0), 6).alias("throughput"))


def summary(ops: DataFrame, by: str = "operation", value: str = "duration_ms") -> DataFrame:
    """by, n, mean, share (of all operations) of each operation and, under null, of all together; uptime in seconds from first to last."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    parts = ops.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(span, 6).alias("uptime"))
    total = ops.agg(F.count(F.lit(1)).alias("all"))
    return parts.crossJoin(F.broadcast(total)).select(by, "n", "mean", F.round(F.col("n") / F.col("all"), 6).alias("share"), "uptime")
