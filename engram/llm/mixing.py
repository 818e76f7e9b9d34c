"""Operator 10: mixing sources to target weights by weighted fair queueing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import documents, drop_table, table

SPACE = "[\\x20\\x09-\\x0D]+"
MOST_COPIES = 3
_FINE = 1024
#: Names for the hashes that tell a row.
MARK = ["_mark_a", "_mark_b"]


def word_count(text: str = "text") -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    squeezed = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.when(F.coalesce(squeezed, F.lit("")) == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, size -> source, rank, source_size, target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; they share the sum of sizes. A target stops at most times
    its source's size, and the rest is shared anew by weight. The level at which this settles has a closed form: in
    ascending order of most * size / weight, sources are capped as long as that ratio is below what is left for them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(w, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("all_size", F.sum("source_size").over(every).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    left = F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # that of the first source not capped; null where all are
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    share = F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.lit(0.0))
    return s.withColumn("final", final).select("source", "rank", "source_size", share.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, seed: int = 42, most: int = MOST_COPIES, marked: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (size * copies) for each row of docs (doc_id, source, text).

    size: another column than the number of words in text. Every source is a queue of its documents in an order shuffled by hash, most times over. A copy's finish time is the
    queue's size up to its end over the source's target; copies are taken in ascending finish time, source and place
    until the budget, the sum of all sizes, is spent. Running sums come from sums of hash slices, so no task holds a
    whole source. In place of a global sort that is cut off at the budget, which moves every row, the place of the cut
    is found: by two histograms of _FINE cells, one inside a cell of the other, and an exact running sum in one cell of
    the second, a millionth of the finish times.
    Documents without words have no share (copies 0), nor does anything if all are so; equal rows are taken alike.
    """
    text = size if size is not None else word_count()
    mark = [F.lit(None).cast("long").alias(c) for c in MARK] if not marked else [F.col(c) for c in MARK]
    base = docs.select("doc_id", "source", text.alias("size"), *mark, F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("key"))
    base = sizes = table(base, "mix_sizes")
    n = max(base.count(), 1)
    bits = min(max((n // 4096).bit_length(), 4), 20)
    base = base.withColumn("slice", F.shiftrightunsigned("key", 64 - bits))
    t = targets(base.select("source", "size"), most)
    slices = base.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    slices = slices.select("source", "slice", (F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).alias("before"))
    slices = slices.join(t, slices["source"].eqNullSafe(t["source"])).drop(t["source"])
    inner = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *MARK).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("upto", F.sum("size").over(inner))
    rows = rows.alias("r").join(slices.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")))
    upto = F.col("before") + F.col("upto")
    rows = table(rows.select("r.doc_id", "r.source", "size", *MARK, "key", "rank", "source_size", "target", upto.alias("upto")), "mix_queues")
    drop_table(sizes)

    def finish(e) -> Column:
        return (F.col("upto") + e * F.col("source_size")) / F.col("target")

    budget = rows.select("source", "source_size").distinct().agg(F.sum("source_size")).first()[0] or 0
    copies = rows.where("size > 0 and target > 0").select("size", "rank", "key", "doc_id", "upto", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("e"), "source_size", "target").withColumn("finish", finish(F.col("e")))
    low, width, spent = 0.0, 4.0, 0  # finish times of 4 on are beyond any cut: at 1 all targets are met
    cell = None
    for _ in range(2):
        at = F.floor((F.col("finish") - F.lit(low)) / F.lit(width) * _FINE)
        h = copies.where((F.col("finish") >= low) & (F.col("finish") < low + width)).groupBy(at.alias("cell")).agg(F.sum("size").alias("n"))
        h = h.select("cell", "n", F.sum("n").over(Window.orderBy("cell")).alias("upto"))  # _FINE rows at most
        cell = h.where(F.col("upto") > budget - spent).orderBy("cell").first()
        if cell is None:
            break
        low, width, spent = low + cell["cell"] * width / _FINE, width / _FINE, spent + cell["upto"] - cell["n"]
    order = ["finish", "rank", "e", "key", "doc_id"]  # equal in all of these: equal rows, taken alike
    if cell is None:
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.lit(most)).otherwise(0)
    else:
        slack = width * 1e-6  # cells are told by arithmetic that may round; the exact sum covers both edges
        edge = copies.where((F.col("finish") >= low - slack) & (F.col("finish") < low + width + slack))
        spent = copies.where(F.col("finish") < low - slack).agg(F.sum("size")).first()[0] or 0
        run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        last = edge.select(*order, run.alias("run")).where(F.col("run") <= budget - spent).orderBy(F.desc("run")).first()

        def fits(e: int) -> Column:
            if last is None:
                return finish(F.lit(e)) < low - slack
            now = F.struct(finish(F.lit(e)).alias("finish"), "rank", F.lit(e).alias("e"), "key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"))
            cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last["e"]).alias("e"), F.lit(last["key"]).alias("key"), F.lit(last["doc_id"] if last["doc_id"] is not None else -(2**63)).cast("long").alias("doc_id"))
            return now <= cut

        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(fits(e).cast("int") for e in range(most))).otherwise(0)
    out = rows.withColumn("copies", taken.cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(MARK if marked else []))


def mix_documents(docs: DataFrame, seed: int = 42, most: int = MOST_COPIES) -> DataFrame:
    """Rows of docs as often as the mix takes them, 0 to most times each, with the columns that docs has.

    A row is found again by two hashes of all its columns; rows that are equal in all of them are dealt their copies
    one by one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(row.alias("row"), "doc_id", "source", "text", *[F.xxhash64(F.lit(i), row).alias(c) for i, c in enumerate(MARK)])
    copies = mix(own, None, seed, most, marked=True).groupBy(*MARK).agg(F.array_sort(F.collect_list("copies")).alias("copies"))
    place = F.row_number().over(Window.partitionBy(*MARK).orderBy(F.lit(0)))
    rows = own.select("row", *MARK).join(copies, MARK).withColumn("place", place)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.element_at("copies", F.col("place"))))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
