"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import drop_table, table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Nodes of edges (a, b: long) with the smallest id of their component: (node, component).

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges form stars; a hub's rows
    are spread by the joins, which adaptive execution can split. Each round is written to the shared folder, so the
    lineage stays short and a lost executor costs one round at most. Self loops keep lone nodes; nulls are dropped.
    """
    now = table(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        both = now.where("a <> b").select("a", "b").union(now.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low2 = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low2, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        after = table(small.union(now.where("a = b")).distinct(), "edges")
        drop_table(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node stands under one smaller node at most, and none that stands under one has others under it."""
    ends = edges.where("a <> b").select(F.col("a").alias("n"), F.lit(1).alias("under"), F.lit(0).alias("over")).union(edges.where("a <> b").select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("under").alias("under"), F.max("over").alias("over")).where("under > 1 or (under > 0 and over > 0)").isEmpty()
