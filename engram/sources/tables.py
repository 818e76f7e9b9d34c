"""The driver's tables, and the memory graph that is derived from them: memories, chunks, vectors, entities, versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators.chunking import fixed_chunks

#: The day from which derived creation times count.
EPOCH = "2024-01-01 00:00:00"
ORPHAN_SHIFT = 1_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """memory_id, text, source, workspace_id, tags, created_at, is_current, stale: one row a document."""
    labels = read(spark, folder, "labels").select("doc_id", "quality")
    tag = F.concat(F.lit("q"), F.col("quality").cast("string"))
    return read(spark, folder, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("memory_id"), "text", "source", F.col("lang").alias("workspace_id"), F.array_compact(F.array("lang", tag)).alias("tags"),
        (F.expr(f"timestamp_ntz'{EPOCH}'") + F.make_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"), F.lit(True).alias("is_current"), (F.col("doc_id") % 7 == 0).alias("stale"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """memory_id, chunk_index, start, text. Every 50th memory's chunks also stand under an id that no memory has."""
    c = fixed_chunks(read(spark, folder, "documents").select(F.col("doc_id").alias("memory_id"), "text"), ["memory_id"])
    return c.unionByName(c.where("memory_id % 50 = 0").withColumn("memory_id", F.col("memory_id") + ORPHAN_SHIFT))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, embedding (doubles), workspace."""
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("workspace"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """id, name, type, confidence, workspace_id of regions, nations, suppliers and customers."""
    def of(table: str, key: str, name: str, mark: str, kind: str) -> DataFrame:
        return read(spark, folder, table).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), ((F.col(key) % 10 + 1) / 10).cast("double").alias("confidence"), F.lit("default").alias("workspace_id"))

    return of("region", "r_regionkey", "r_name", "r", "GPE").unionByName(of("nation", "n_nationkey", "n_name", "n", "GPE")).unionByName(of("supplier", "s_suppkey", "s_name", "s", "ORG")).unionByName(of("customer", "c_custkey", "c_name", "c", "PERSON"))


def relationships(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, type, strength: nation to region, supplier and customer to nation."""
    mark = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    nation = read(spark, folder, "nation").select(mark("n", "n_nationkey").alias("src"), mark("r", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"), F.lit(0.9).alias("strength"))
    rest = [read(spark, folder, t).select(mark(m, k).alias("src"), mark("n", n).alias("dst"), F.lit("LOCATED_IN").alias("type"), ((F.col(k) % 10 + 1) / 10).cast("double").alias("strength")) for t, m, k, n in (("supplier", "s", "s_suppkey", "s_nationkey"), ("customer", "c", "c_custkey", "c_nationkey"))]
    return nation.unionByName(rest[0]).unionByName(rest[1])


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """caller, callee, line, type, args from line items."""
    kind = F.when(F.col("l_returnflag") == "A", "function").when(F.col("l_returnflag") == "N", "method").otherwise("constructor")
    return read(spark, folder, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("caller"), F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("callee"), F.col("l_linenumber").cast("long").alias("line"), kind.alias("type"), F.floor(F.col("l_quantity") % 5).cast("long").alias("args"))


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of a file for each user: an event is a version, valid until the next; purchases that come last delete."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = F.expr("interval 1 hour")
    v = read(spark, folder, "events").select(
        F.col("event_id").alias("memory_id"), F.concat(F.lit("/src/"), (F.col("user_id") % 5).cast("string"), F.lit("/user"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"), F.row_number().over(w).cast("long").alias("version"),
        F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), (F.col("ts") + hour).alias("created_at"), (F.lead("ts").over(w) + hour).alias("transaction_to"), F.lag("event_id").over(w).alias("previous_version_id"), "event_type", "value",
    )
    gone = F.col("valid_to").isNull() & (F.col("event_type") == "purchase")
    return v.withColumn("is_current", F.col("valid_to").isNull() & ~gone).withColumn("transaction_to", F.when(gone, F.col("created_at") + hour).otherwise(F.col("transaction_to")))


def qrels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, grade (quality * 2 + 1 - toxic), relevant (quality is 1)."""
    return read(spark, folder, "labels").select("doc_id", (F.col("quality") * 2 + 1 - F.col("toxic")).cast("double").alias("grade"), (F.col("quality") == 1).alias("relevant"))


def ops(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(F.col("event_id").alias("op_id"), F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"), "ts")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, md: every document as a page with headings, links, emphasis and a fence around its number."""
    fence = F.lit("```")
    parts = [
        F.lit("# Page "), F.col("doc_id"), F.lit("\n\n"), F.lit("Some **bold** and ~~old~~ words, [a link](http://x.org/"), F.col("doc_id"), F.lit(") and <https://y.org/"), F.col("doc_id"), F.lit(">.\n\n## Text ##\n\n"),
        F.coalesce("text", F.lit("")), F.lit("\n\n"), fence, F.lit("python\nx = "), F.col("doc_id"), F.lit("\n"), fence, F.lit("\n\n### End\n\n- ![pic](p.png)\n"),
    ]
    return read(spark, folder, "documents").select("doc_id", F.concat(*[p.cast("string") for p in parts]).alias("md"))


#: Sources by number: {0} is a part's key, {1} half of it.
_SOURCES = {
    "py": "import os\nfrom typing import List\n\n\nclass C{0}(C{1}):\n    def run(self, x):\n        self.log(x)\n        return helper{0}(x, 1)\n\n\ndef helper{0}(x, y):\n    return len(x) + C{0}()\n",
    "ts": "// c\nexport class C{0} extends C{1} {{\n  run(x: string) {{ this.log(x); return helper{0}(x, 1); }}\n}}\nfunction helper{0}(x, y) {{ return parseInt(x) + new C{0}(); }}\n",
    "go": "package main\n\ntype C{0} struct {{\n}}\n\nfunc (c *C{0}) run(x string) int {{\n\tc.log(x)\n\treturn helper{0}(x, 1)\n}}\n\nfunc helper{0}(x string, y int) int {{\n\treturn len(x)\n}}\n",
    "rs": "pub struct C{0} {{\n}}\n\nimpl C{0} {{\n    pub fn run(&self, x: &str) -> i32 {{\n        self.log(x);\n        helper{0}(x, 1)\n    }}\n}}\n\nfn helper{0}(x: &str, y: i32) -> i32 {{\n    println!(\"a\");\n    0\n}}\n",
}


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """relative_path, path, size, text: a source file for every part, in four languages by its key."""
    key = F.col("p_partkey")
    kinds = list(_SOURCES)
    text = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        pieces = [F.lit(x) if j % 2 == 0 else (key if x == "0" else F.floor(key / 2)).cast("string") for j, x in enumerate(_pieces(_SOURCES[k]))]
        text = F.when(key % len(kinds) == i, F.concat(*pieces)).otherwise(text)
    ext = F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % len(kinds) + 1).cast("int"))
    path = F.concat(F.lit("src/m"), key.cast("string"), F.lit("."), ext)
    return read(spark, folder, "part").select(path.alias("relative_path"), path.alias("path"), F.octet_length(text).cast("long").alias("size"), text.alias("text"), key.alias("key"))


def _pieces(source: str) -> list[str]:
    """Text, number of a place, text, ...: a source with its braces undoubled."""
    out = re.split(r"\{([01])\}", source.replace("{{", "\x01").replace("}}", "\x02"))
    return [x.replace("\x01", "{").replace("\x02", "}") for x in out]
