"""Retrieval metrics over ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(hits: DataFrame, relevant: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, recall, precision, mrr, ndcg, ap of each list.

    hits: by, id, rank (from 1); relevant: by, id, grade (relevant above 0). recall = hits in the first k / relevant;
    precision = those / k; mrr = 1 / first hit's rank; ap = precision at each hit / relevant; gains are 2^grade - 1.
    Without relevant rows, or with k below 1, all that depends on them is 0. Lists are joined and summed, never
    collected; ideal ranks come from the first k relevant rows of one list.
    """
    by = by or ["_list"]
    one = "_list" in by
    h = hits.withColumn("_list", F.lit(1)) if one else hits
    r = (relevant.withColumn("_list", F.lit(1)) if one else relevant).where("grade > 0").select(*by, "id", "grade")
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    # each task keeps k rows of a list, so a long list isn't sorted in one
    top = r.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("grade"), "id"))).where(F.col("place") <= k)
    ideal = top.groupBy(*by).agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    total = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(ideal, by, "left")
    found = h.dropDuplicates([*by, "id"]).join(r, [*by, "id"], "left").withColumn("hit", F.col("grade").isNotNull().cast("int"))
    found = found.withColumn("seen", F.sum("hit").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    got = found.groupBy(*by).agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= k), gain(F.col("grade"), F.col("rank")))).alias("dcg"), F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank"))).alias("precisions"),
    )
    s = got.join(total, by, "left")
    ok = (F.col("n") > 0) & F.lit(k > 0)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    out = s.select(
        *by, zero(F.when(ok, F.col("hits") / F.col("n"))).alias("recall"), zero(F.when(F.lit(k > 0), F.col("hits") / F.lit(max(k, 1)))).alias("precision"), zero(1 / F.col("first")).alias("mrr"),
        zero(F.when(ok & (F.col("ideal") > 0), F.col("dcg") / F.col("ideal"))).alias("ndcg"), zero(F.when(F.col("n") > 0, F.col("precisions") / F.col("n"))).alias("ap"),
    )
    return out.drop("_list")
