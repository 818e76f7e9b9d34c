"""Shared plumbing: the shared work folder, tables that cut lineage, code for the workers, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import sys
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.store import remove, work_dir

NULL_ID = np.iinfo(np.int64).max

#: Folders of written tables that stand, by application.
_TABLES: dict[str, list[str]] = {}


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows doesn't recompute what came before."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def written(spark: SparkSession) -> int:
    """How many tables of this session stand."""
    return len(_TABLES.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables that operators of this session have written, from the since-th on.

    For a job to call once the results that read them are written themselves.
    """
    mine = _TABLES.get(spark.sparkContext.applicationId, [])
    while len(mine) > since:
        remove(spark, mine.pop())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the tables written inside the block, also after an error, but for those given to the function it yields."""
    mine = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(mine), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_at)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        for path in [p for p in mine if p not in before and p not in kept]:
            mine.remove(path)
            remove(spark, path)


def drop_table(df: DataFrame) -> None:
    """Removes a table that ``table`` wrote and that nothing reads any more."""
    mine = _TABLES.get(df.sparkSession.sparkContext.applicationId, [])
    if df.written_at in mine:
        mine.remove(df.written_at)
        remove(df.sparkSession, df.written_at)


_SHIPPED: set[str] = set()
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session; they need not see the driver's folders."""
    if spark.conf.get(_ARROW_BYTES, None) in (None, "-1"):  # batches by size, so that long texts don't add up
        spark.conf.set(_ARROW_BYTES, str(4 << 20))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    folder = Path(os.environ.get("ENGRAM_SHIP_DIR", "/tmp")) / f"engram-ship-{os.getpid()}-{app}"
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / "engram_code.zip"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    target.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def tidy(run):
    """A mapInArrow function that leaves no memory behind in its Python worker, which serves one stage after another.

    Not for the tokenizers' own stages: what they remember serves their later tasks.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    if tokens := sys.modules.get("engram.llm.tokens"):
        for kept in (tokens.word_tokens, tokens.byte_tokens, tokens.load):
            kept.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as int64; a null id becomes NULL_ID, which is never smaller than another."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(column, NULL_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.fill_null(column, NULL_ID).to_numpy(), np.int64)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = text_bytes(b.column(b.schema.get_field_index(text)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def free_name(df: DataFrame, name: str) -> str:
    """name, or with as many _ behind it as no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def about_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column as the sizes of a lone source's files tell, three times theirs; else by a scan.

    Good for numbers of partitions: it may be off by as much as the text compresses.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = int(str(leaves.apply(0).stats().sizeInBytes())) if leaves.size() == 1 else 0
    return 3 * size if 0 < size < 1 << 55 else total_bytes(df, column)  # a source of unknown size has the greatest number


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
