"""Texts cut into windows of characters or lines, or along their own seams, and small pieces merged."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seams from the widest to the narrowest.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ")


def _windows(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows over n items: the last is the first that reaches the end; none where n is 0."""
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def fixed_chunks(df: DataFrame, keys: list[str], size: int = 512, overlap: int = 50) -> DataFrame:
    """keys, chunk_index, start, text: windows of size characters that overlap by so many; nulls have none."""
    n = F.coalesce(F.length("text"), F.lit(0))
    cut = df.select(*keys, "text", F.posexplode(_windows(n, size, overlap)).alias("chunk_index", "start"))
    return cut.select(*keys, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("text"))


def line_chunks(df: DataFrame, keys: list[str], lines: int = 20, overlap: int = 5) -> DataFrame:
    """keys, chunk_index, first_line (from 1), n_lines, text: windows of lines, with true places."""
    rows = df.where(F.length("text") > 0).withColumn("_lines", F.split("text", "\n"))
    cut = rows.select(*keys, "_lines", F.posexplode(_windows(F.size("_lines"), lines, overlap)).alias("chunk_index", "at"))
    part = F.slice("_lines", F.col("at") + 1, lines)
    return cut.select(*keys, F.col("chunk_index").cast("long").alias("chunk_index"), (F.col("at") + 1).cast("long").alias("first_line"), F.size(part).cast("long").alias("n_lines"), F.array_join(part, "\n").alias("text"))


def merge_small(pieces: Column, least: int) -> Column:
    """Array of texts in which one shorter than least joins the next, which is then spent; a last one joins the one before.

    A fold over (done, held): a held piece waits for the next one.
    """
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("held"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.struct(F.concat(acc["done"], F.array(F.concat(acc["held"], x))).alias("done"), none.alias("held"))
        waits = F.struct(acc["done"].alias("done"), x.alias("held"))
        stays = F.struct(F.concat(acc["done"], F.array(x)).alias("done"), none.alias("held"))
        return F.when(acc["held"].isNotNull(), joined).when(F.length(x) < least, waits).otherwise(stays)

    def end(acc: Column) -> Column:
        done, held = acc["done"], acc["held"]
        n = F.size(done)
        before = F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), held)))
        return F.when(held.isNull(), done).when(n == 0, F.array(held)).otherwise(before)

    return F.aggregate(pieces, start, step, end)


def least_size(size: int) -> int:
    """Characters below which a chunk is small, by default."""
    return 100 if size >= 100 else max(1, size // 5)


def checked(size: int, overlap: int, least: int | None = None) -> int:
    """The least size that these settings ask for; an error where they are out of range."""
    if not 10 <= size <= 2048:
        raise ValueError("size must be from 10 to 2048")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    if least is None:
        return least_size(size)
    if not 1 <= least <= size:
        raise ValueError("the least size must be from 1 to size")
    return least


def words(text: str) -> int:
    return len(text.split())


def _cut(text: str, a: int, b: int, size: int, separators: tuple[str, ...], count: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """Spans of text[a:b] of at most size tokens, cut behind the widest separator that a span holds; else between words."""
    if count(text[a:b]) <= size:
        yield a, b
        return
    for k, s in enumerate(separators):
        at = text.find(s, a, b)
        if at >= 0 and at + len(s) < b:
            while at >= 0:
                yield from _cut(text, a, at + len(s), size, separators[k + 1 :], count)
                a = at + len(s)
                at = text.find(s, a, b)
            if a < b:
                yield from _cut(text, a, b, size, separators[k + 1 :], count)
            return
    starts = [m.start() + a for m in re.finditer(r"\S+", text[a:b])]
    for i in range(0, len(starts), size):
        yield (starts[i] if i else a), (starts[i + size] if i + size < len(starts) else b)


def spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, count: Callable[[str], int] = words) -> list[tuple[int, int]]:
    """Places of chunks of at most size tokens; each begins with as many whole pieces of the one before as overlap holds."""
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int, int]] = []
    for a, b in _cut(text, 0, len(text), size, tuple(separators), count):
        n = count(text[a:b])
        if held and sum(x[2] for x in held) + n > size:
            out.append((held[0][0], held[-1][1]))
            while held and (sum(x[2] for x in held) > overlap or sum(x[2] for x in held) + n > size):
                held.pop(0)
        held.append((a, b, n))
    if held:
        out.append((held[0][0], held[-1][1]))
    return out


def merged(parts: list[tuple[int, int, str]], least: int) -> list[tuple[int, int, str]]:
    """(start, end, text) with those shorter than least joined: each to the next, which is then spent; a last one to the one before."""
    out: list[tuple[int, int, str]] = []
    i = 0
    while i < len(parts):
        a, b, t = parts[i]
        if len(t) < least and i + 1 < len(parts):
            _, b, more = parts[i + 1]
            out.append((a, b, t + more))
            i += 2
            continue
        if len(t) < least and out:
            first, _, before = out.pop()
            out.append((first, b, before + t))
        else:
            out.append((a, b, t))
        i += 1
    return out


def recursive_chunks(df: DataFrame, key: str, size: int = 512, overlap: int = 50, least: int | None = None, separators: tuple[str, ...] = SEPARATORS, count: Callable[[str], int] = words) -> DataFrame:
    """key, chunk_index, start, end, text: chunks of at most size tokens along paragraphs, lines and sentences.

    Small ones (least characters, see ``checked``) are merged. count: the tokens of a text, words by default. Null and
    blank texts have no chunks.
    """
    least = checked(size, overlap, least)
    if not separators:
        raise ValueError("separators must not be empty")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                if text and text.strip():
                    got = merged([(x, y, text[x:y]) for x, y in spans(text, size, overlap, separators, count)], least)
                    own = pa.concat_arrays([b.column(0).slice(i, 1)] * len(got))
                    yield pa.RecordBatch.from_arrays([own, pa.array(range(len(got)), pa.int64()), pa.array([x for x, _, _ in got], pa.int64()), pa.array([y for _, y, _ in got], pa.int64()), pa.array([t for _, _, t in got], pa.string())], [key, "chunk_index", "start", "end", "text"])

    return df.select(key, "text").mapInArrow(run, f"{key} {kind}, chunk_index long, start long, end long, text string")
