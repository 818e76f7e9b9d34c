"""Event-time rollups that give the same rows over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import store
from engram.operators import temporal


def _keyed(events: DataFrame, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if e.isStreaming else e


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of windows of a size, one each slide (or side by side)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = _keyed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n: a user's events of which each comes within the gap of the one before."""
    g = _keyed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", **options: str):
    """Drains what a stream has now into Parquet, and ends; a later run goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest(turns: DataFrame, late: str = "1 hour", time: str | None = None) -> DataFrame:
    """Memories from turns (conv_id, turn, role, text): blank ones left out, repeated deliveries once.

    time: the column of a delivery's time; a stream without one takes the time of its arrival. On a stream a repetition
    is known for late after the first, by the watermark, so the state doesn't grow for ever.
    """
    t = turns.where(F.trim("text") != "").withColumn("memory_id", F.sha2(F.concat_ws("|", "conv_id", "turn"), 256))
    if t.isStreaming:
        t = t.withColumn("_seen", F.col(time).cast("timestamp") if time else F.current_timestamp()).withWatermark("_seen", late).dropDuplicatesWithinWatermark(["memory_id"])
    else:
        t = t.dropDuplicates(["memory_id"])
    return t.select("memory_id", F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source"), "role", "text")


def change_feed(versions: DataFrame, since: str | None = None, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """memory_id, version, file_path, created_at, change_type of versions as they come: ``temporal.changes`` without an order."""
    return temporal.changed(versions, since, None, kind, prefix).select("memory_id", "version", "file_path", "created_at", "change_type")


def latency(ops: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, operation, n, low, high, mean of operations (ts, operation, duration_ms) by window."""
    g = _keyed(ops, late).groupBy(F.window("ts", size).alias("w"), "operation")
    v = F.col("duration_ms")
    g = g.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"))
    return g.select(F.col("w.start").alias("start"), "operation", "n", "low", "high", "mean")


def expired_sessions(events: DataFrame, lifetime: str, now: str, by: str = "user_id") -> DataFrame:
    """by, started, expired: whether a session's lifetime, from its first event on, is over at a time."""
    first = events.groupBy(by).agg(F.min("ts").alias("started"))
    return first.select(by, "started", (F.col("started") + F.expr(f"interval {lifetime}") <= F.lit(now).cast("timestamp_ntz")).alias("expired"))


def upsert_stream(rows: DataFrame, folder: str, checkpoint: str, key: str = "memory_id", order: str = "digest"):
    """Keeps a table of the last row of each key from a stream of rows; ends when what there is has been taken in.

    Each micro-batch writes the next version of the table (folder/v<batch>) from the last one, so a batch that is run
    again writes the same, and a reader of the last whole version sees no half of one. Of a batch's rows with one key
    the greatest by order stays.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        before = last_version(spark, folder, number)
        out = new if before is None else before.select(*batch.columns).join(new.select(key), key, "left_anti").select(*batch.columns).unionByName(new)
        out.write.mode("overwrite").parquet(f"{folder}/v{number:09d}")

    q = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def last_version(spark: SparkSession, folder: str, before: int = 10**9) -> DataFrame | None:
    """The last whole version that ``upsert_stream`` wrote, or the last below a number; None without one."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    whole = [n for n in names if n.startswith("v") and int(n[1:]) < before and store.exists(spark, f"{folder}/{n}/_SUCCESS")]
    return spark.read.parquet(f"{folder}/{whole[-1]}") if whole else None
