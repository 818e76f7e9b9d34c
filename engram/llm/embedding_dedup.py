"""Operator 6: near-duplicate vectors by random-hyperplane sign hashing, exact cosines and connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import scratch, ship, table, tidy
from engram.llm.components import components

#: Vectors of one bucket that are compared in one block; larger buckets take pairs of blocks.
BLOCK = 2048
SEED = 11
#: Signs that every vector has at least, and standard errors by which the signs' estimate of an angle may be off.
LEAST_SIGNS, SIGMAS = 256, 5
_STRIP = 256


def plan(n: int, cosine: float, recall: float, bits: int | None = None) -> tuple[int, int]:
    """Bits per table so that a bucket has about 1024 vectors of n spread evenly, and tables for the recall at the threshold."""
    bits = bits or max(2, round(math.log2(max(n, 2))) - 10)
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def most_apart(signs: int, cosine: float) -> int:
    """Signs in which two vectors at the threshold differ, and SIGMAS standard errors more."""
    p = math.acos(cosine) / math.pi
    return math.floor(signs * p + SIGMAS * math.sqrt(signs * p * (1 - p)))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors that take part; None for null and zero vectors and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        x = column[i].values if column[i].is_valid else None
        if x is None or not len(x) or x.null_count:
            out.append(None)
            continue
        v = x.to_numpy(zero_copy_only=False)
        d = v.astype(np.float64)
        norm = float(np.sqrt(d @ d)) if np.isfinite(d).all() else 0.0
        out.append(v if norm > 0 and math.isfinite(norm) else None)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex number of each vertex's component in a small graph."""
    low = np.arange(n)
    while True:
        new = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


class _Group:
    """Vectors of one bucket and pair of blocks (i, j) of table t: signs as 64-bit words, own blocks."""

    def __init__(self, t: int, i: int, j: int, own: np.ndarray, sketch: np.ndarray, bits: int):
        self.t, self.same = t, i == j
        self.p, self.q = np.flatnonzero(own == i), np.flatnonzero(own == j)
        self.sketch = sketch
        signs = np.unpackbits(sketch[:, : -(-t * bits // 64)].view(np.uint8), axis=1, bitorder="little")[:, : t * bits] if t else np.zeros((len(sketch), 0), np.uint8)
        self.keys = signs.reshape(len(sketch), t, bits) @ (1 << np.arange(bits))  # those of earlier tables

    def first_here(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs (a, b) those that share no bucket of an earlier table."""
        if self.t and len(a):
            new = (self.keys[a] != self.keys[b]).all(axis=1)
            return a[new], b[new]
        return a, b

    def likely(self, most: int) -> np.ndarray:
        """Whether each vector has a partner here of at most so many other signs, and meets it here first."""
        out = np.zeros(len(self.sketch), bool)
        for k in range(0, len(self.p), _STRIP):
            p = self.p[k : k + _STRIP]
            apart = np.zeros((len(p), len(self.q)), np.int32)
            for w in range(self.sketch.shape[1]):
                apart += np.bitwise_count(self.sketch[p, w][:, None] ^ self.sketch[self.q, w])
            ok = apart <= most
            if self.same:
                ok &= self.q > p[:, None]
            x, y = np.nonzero(ok)
            for c in range(0, len(x), 1 << 20):
                a, b = self.first_here(p[x[c : c + (1 << 20)]], self.q[y[c : c + (1 << 20)]])
                out[a] = out[b] = True
        return out

    def links(self, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b) of at least that cosine that meet here first. vectors: of unit length."""
        out = []
        for k in range(0, len(self.p), _STRIP):
            p = self.p[k : k + _STRIP]
            ok = vectors[p] @ vectors[self.q].T >= cosine
            if self.same:
                ok &= self.q > p[:, None]
            x, y = np.nonzero(ok)
            out.append(self.first_here(p[x], self.q[y]))
        return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, np.int64),) * 2


_GROUP = ["dim", "t", "key", "i", "j"]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group, one after the other, from batches in the order of _GROUP, the first columns."""
    rest: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        g = np.stack([b.column(c).to_numpy() for c in range(len(_GROUP))])
        cut = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cut, cut[1:], strict=False):
            if rest and tuple(g[:, a]) != now:
                yield pa.Table.from_batches(rest)
                rest = []
            now = tuple(g[:, a])
            rest.append(b.slice(a, z - a))
    if rest:
        yield pa.Table.from_batches(rest)


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding: array of float or double).

    Links are pairs of vectors of one dimension with a cosine, in double precision, of at least cosine; none below.
    Vectors that are null, zero, empty or hold null or non-finite components, and rows without an id, link with
    nothing. Equal vectors form a class from the start: its members link with each other, and a link of classes counts
    for all their members; an id that several rows have may stand for several vectors. Each table hashes a class by the
    signs of its products with random directions. What is dealt to buckets is ids and signs: those of all tables tell
    vectors that have a likely partner in the bucket (a margin of SIGMAS standard errors at the threshold), and for
    these alone vectors are fetched, and cosines decide. A pair counts in the first table where it meets. Buckets
    beyond block vectors are cut into blocks, and each pair of blocks is a task's work of its own: all pairs are
    compared, none in one task.
    """
    spark = vectors.sparkSession
    ship(spark)
    wide = "double" in vectors.schema["embedding"].dataType.simpleString()
    kind = "<f8" if wide else "<f4"
    bits, tables = plan(vectors.count(), cosine, recall, bits)
    signs = -(-max(LEAST_SIGNS, bits * tables) // 64) * 64
    most = most_apart(signs, cosine)
    fields = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("dim", pa.int32()), ("vec", pa.binary()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            got = _vectors(b.column(1))
            dims = np.array([0 if v is None else len(v) for v in got])
            sketch: list[bytes | None] = [None] * len(got)
            keys: list = [None] * len(got)
            for d in np.unique(dims[dims > 0]).tolist():
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([SEED, d])).standard_normal((d, signs))
                mine = np.flatnonzero(dims == d)
                s = np.stack([got[r] for r in mine]).astype(np.float64) @ planes[d] > 0
                packed = np.packbits(s, axis=1, bitorder="little")
                own = s[:, : bits * tables].reshape(len(mine), tables, bits) @ (1 << np.arange(bits))
                for r, x, k in zip(mine.tolist(), packed, own, strict=True):
                    sketch[r], keys[r] = x.tobytes(), k
            raw = [None if v is None else (v + 0.0).astype(kind).tobytes() for v in got]  # -0.0 becomes 0.0
            digests = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            dim = pa.array([None if v is None else len(v) for v in got], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), dim, pa.array(raw, pa.binary()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], schema=fields)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches):
            if t.num_rows > 1:
                g = [t.column(c)[0].as_py() for c in range(len(_GROUP))]
                some = _Group(g[1], g[3], g[4], t.column("own").to_numpy(), _matrix(t.column("sketch"), "<u8"), bits).likely(most)
                if some.any():
                    yield from t.drop_columns(["sketch"]).filter(pa.array(some)).combine_chunks().to_batches()

    found = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches):
            if t.num_rows < 2:
                continue
            t = t.sort_by("id")
            g = [t.column(c)[0].as_py() for c in range(len(_GROUP))]
            ids, times = t.column("id").to_numpy(), t.column("times").to_numpy()
            group = _Group(g[1], g[3], g[4], t.column("own").to_numpy(), _matrix(t.column("sketch"), "<u8"), bits)
            a, b = group.links(_unit(_matrix(t.column("vec"), kind)), cosine)
            if len(a):
                links = np.bincount(a, times[b], len(ids)) + np.bincount(b, times[a], len(ids))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[_labels(len(ids), a, b)[some]])], schema=found)

    def grouped(df: DataFrame, size: int) -> DataFrame:
        """df in partitions of about 32 MB that hold whole groups, one after the other. size: bytes of df, about."""
        slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, size // (32 << 20))
        return df.repartition(slots, *_GROUP).sortWithinPartitions(*_GROUP)

    with scratch(spark) as keep:
        rows = keep(table(vectors.select("vec_id", "embedding").mapInArrow(tidy(read), "vec_id long, digest binary, dim int, vec binary, sketch binary, keys array<int>"), "vectors"))
        usable = rows.where("vec is not null and vec_id is not null")
        first = F.first(F.struct("dim", "sketch", "keys")).alias("r")
        classes = keep(table(usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), first).select("digest", "id", "times", "r.*"), "vector_classes"))
        spots = classes.select("digest", "id", "times", "dim", "sketch", F.posexplode("keys").alias("t", "key"))
        large = spots.groupBy("dim", "t", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")).where("cuts > 1")
        dealt = spots.join(table(large, "large_buckets"), ["dim", "t", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("digest", "t"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*_GROUP, "own", "id", "digest", "times", "sketch")
        size = classes.count() * tables * (signs // 8 + 64)
        survivors = grouped(dealt, size).mapInArrow(tidy(likely), "dim int, t int, key int, i int, j int, own int, id long, digest binary, times long")
        survivors = table(survivors, "likely_vectors")
        full = usable.select(F.col("vec_id").alias("id"), "digest", "vec", "sketch").dropDuplicates(["id", "digest"]).join(survivors.select("id", "digest").distinct(), ["id", "digest"], "left_semi")
        full = survivors.join(full, ["id", "digest"]).select(*_GROUP, "own", "id", "times", "vec", "sketch")
        full = table(full, "likely_full")
        size = full.agg(F.sum(F.octet_length("vec") + F.octet_length("sketch") + 64)).first()[0] or 0
        links = keep(table(grouped(full, size).mapInArrow(tidy(compare), "id long, links long, low long"), "vector_links"))
        comp = keep(table(components(links.select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b")), "vector_components"))
    sums = links.groupBy("id").agg(F.sum("links").alias("links"))
    return _report(rows, classes, sums, comp)


def _report(rows: DataFrame, classes: DataFrame, sums: DataFrame, comp: DataFrame) -> DataFrame:
    named = classes.select("digest", "id", "times").join(sums, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    named = named.select("digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
