"""Bi-temporal versions: reads as of a time, histories, the change feed, and edits that give a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.store import materialised, remove

Time = Column | str


def _ts(t: Time) -> Column:
    return F.lit(t).cast("timestamp_ntz") if isinstance(t, str) else t


def alive(t: Time, kind: str = "valid") -> Column:
    """Whether a version's half-open interval holds t. kind: valid, transaction or both."""
    at = _ts(t)
    within = lambda a, b: (F.col(a) <= at) & (F.col(b).isNull() | (F.col(b) > at))
    valid, known = within("valid_from", "valid_to"), within("created_at", "transaction_to")
    return {"valid": valid, "transaction": known, "both": valid & known}[kind]


def as_of(versions: DataFrame, t: Time, kind: str = "valid", key: str = "file_path", limit: int | None = None) -> DataFrame:
    """The last version of each key that was alive at t: a filter, then the greatest by a map-side aggregate."""
    order = F.struct("version", "valid_from", "memory_id")
    rest = F.struct(*versions.columns)
    out = versions.where(alive(t, kind)).groupBy(key).agg(F.max_by(rest, order).alias("_r")).select("_r.*")
    return out if limit is None else out.orderBy(F.desc("valid_from"), "memory_id").limit(limit)


def as_of_many(versions: DataFrame, probes: DataFrame, key: str = "file_path") -> DataFrame:
    """For each probe (probe_id, key, t) the version alive then: an as-of join in one pass.

    Versions and probes of a key are sorted together by time, and each probe takes the last version before it; so a
    key's rows meet once, however many versions there are.
    """
    v = versions.select(key, F.col("valid_from").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("probe_id"), F.struct("memory_id", "version", "valid_to").alias("_v"))
    p = probes.select(key, F.col("t").alias("_t"), F.lit(1).alias("_side"), F.col("probe_id").cast("long").alias("probe_id"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side", F.col("_v.version")).rowsBetween(Window.unboundedPreceding, 0)
    out = v.unionByName(p).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    live = F.col("_last").isNotNull() & (F.col("_last.valid_to").isNull() | (F.col("_last.valid_to") > F.col("_t")))
    return out.select("probe_id", key, F.when(live, F.col("_last.memory_id")).alias("memory_id"), F.when(live, F.col("_last.version")).alias("version"))


def history(versions: DataFrame, file_path: str | None = None, memory_id: int | None = None, limit: int = 100) -> DataFrame:
    """Versions of a path, or the one of an id, newest first."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    what = F.col("file_path") == file_path if file_path is not None else F.col("memory_id") == memory_id
    return versions.where(what).orderBy(F.desc("valid_from"), F.desc("memory_id")).limit(limit)


def version_chain(versions: DataFrame, memory_id: int) -> DataFrame:
    """memory_id, version, depth of the version of an id (depth 0) and all before it by previous_version_id.

    Links are followed by doubling: from those over one version come those over two, four and so on, each written, so a
    chain of n versions takes about log2(n) joins. A chain that comes back to a version it had ends there.
    """
    links = versions.select("memory_id", "version", F.col("previous_version_id").alias("to"))
    rows = materialised(links, "versions")
    jump, made = rows.where("to is not null").select("memory_id", "to"), [rows]
    found = rows.where(F.col("memory_id") == memory_id).select("memory_id", F.lit(0).cast("long").alias("depth"))
    step = 1
    while True:
        more = F.broadcast(found).join(jump, "memory_id").select(F.col("to").alias("memory_id"), (F.col("depth") + step).alias("depth"))
        after = materialised(found.unionByName(more).groupBy("memory_id").agg(F.min("depth").alias("depth")), "chain")
        made.append(after)
        if after.count() == found.count():
            break
        found, step = after, 2 * step
        jump = materialised(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.memory_id")).select("a.memory_id", "b.to"), "jumps")
        made.append(jump)
    out = materialised(F.broadcast(after).join(rows, "memory_id").select("memory_id", "version", "depth"), "version_chain")
    for x in made:
        remove(versions.sparkSession, x.written_at)
    return out


def change_type() -> Column:
    """The first that fits: version 1 is created even where it was deleted since."""
    return F.when(F.col("version") == 1, "created").when(F.col("transaction_to").isNotNull() & ~F.col("is_current"), "deleted").otherwise("modified")


def changed(versions: DataFrame, since: Time | None = None, until: Time | None = None, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """Versions with change_type: created at since or later and before until, under a path prefix.

    kind: created (version 1), modified (later ones), deleted (any whose transaction time has ended).
    """
    keep = F.lit(True)
    if since is not None:
        keep &= F.col("created_at") >= _ts(since)
    if until is not None:
        keep &= F.col("created_at") < _ts(until)
    if prefix is not None:
        keep &= F.col("file_path").startswith(prefix)
    if kind is not None:
        keep &= {"created": F.col("version") == 1, "modified": F.col("version") > 1, "deleted": F.col("transaction_to").isNotNull()}[kind]
    return versions.where(keep).withColumn("change_type", change_type())


def changes(versions: DataFrame, since: Time | None = None, until: Time | None = None, kind: str | None = None, prefix: str | None = None, limit: int | None = 100) -> DataFrame:
    """``changed``, newest first."""
    out = changed(versions, since, until, kind, prefix).orderBy(F.desc("created_at"), F.desc("memory_id"))
    return out if limit is None else out.limit(limit)


def _edit(df: DataFrame, where: Column, **new: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def close_version(versions: DataFrame, memory_id: int, t: Time) -> DataFrame:
    at = _ts(t)
    return _edit(versions, F.col("memory_id") == memory_id, valid_to=at, transaction_to=at, is_current=F.lit(False))


def soft_delete(versions: DataFrame, memory_id: int, t: Time) -> DataFrame:
    """Ends the transaction time; the valid time stays open."""
    return _edit(versions, F.col("memory_id") == memory_id, transaction_to=_ts(t), is_current=F.lit(False))


def new_version(versions: DataFrame, memory_id: int, new_id: int, t: Time, **changed: Column) -> DataFrame:
    """versions with the one of memory_id closed at t and its successor added, which copies all but what changed names."""
    at = _ts(t)
    none = F.lit(None).cast("timestamp_ntz")
    own = dict(memory_id=F.lit(new_id).cast("long"), version=F.col("version") + 1, previous_version_id=F.lit(memory_id).cast("long"), valid_from=at, created_at=at, valid_to=none, transaction_to=none, is_current=F.lit(True)) | changed
    after = versions.where(F.col("memory_id") == memory_id).withColumns(own)
    return close_version(versions, memory_id, t).unionByName(after)


def migrate(memories: DataFrame) -> DataFrame:
    """Old rows get what versions have: version 1, current, valid and known since their creation."""
    has = lambda c: F.col(c) if c in memories.columns else F.lit(None)
    none = lambda c: has(c).cast("timestamp_ntz")
    return memories.withColumns({
        "version": F.coalesce(has("version").cast("long"), F.lit(1).cast("long")), "is_current": F.coalesce(has("is_current").cast("boolean"), F.lit(True)),
        "valid_from": F.coalesce(none("valid_from"), F.col("created_at")), "valid_to": none("valid_to"), "transaction_to": none("transaction_to"), "previous_version_id": has("previous_version_id").cast("long"),
    })


def migration_status(memories: DataFrame) -> DataFrame:
    """total, migrated (version, current flag and start of validity are set), pending; columns that aren't there are not set."""
    done = F.lit(True)
    for c in ("version", "is_current", "valid_from"):
        done &= F.col(c).isNotNull() if c in memories.columns else F.lit(False)
    return memories.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("migrated"), F.count_if(~done).alias("pending"))


def migrate_dry_run(memories: DataFrame) -> DataFrame:
    """change, n: how many rows a migration would give each field."""
    fields = ("version", "is_current", "valid_from")
    one = memories.agg(*[(F.count_if(F.col(c).isNull()) if c in memories.columns else F.count(F.lit(1))).alias(c) for c in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("change"), F.col(c).alias("n")) for c in fields])).alias("x")).select("x.*")


def roll_back(memories: DataFrame) -> DataFrame:
    """Migrated rows as they were: first versions without the fields of versions; later versions go."""
    gone = ("version", "is_current", "valid_from", "valid_to", "transaction_to", "previous_version_id")
    return memories.where("version = 1").drop(*gone)


def migrate_workspace(df: DataFrame, default: str = "default") -> DataFrame:
    return df.withColumn("workspace_id", F.coalesce("workspace_id", F.lit(default)))
