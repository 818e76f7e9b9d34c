"""Operator 4: near-duplicate documents by min-max hashing, exact confirmation and connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import documents, free_name, scratch, ship, small_batches, table, text_bytes, tidy
from engram.llm.components import components
from engram.llm.words import U, Words, grams, mix

PERMUTATIONS = 48
#: Values in a band.
ROWS = 4
#: Standard errors below the threshold at which sketches rule a pair out.
SIGMAS = 5
#: Members of a bucket that are compared in one group; larger buckets take pairs of blocks.
LARGE = 4000
#: Ids that may be broadcast (16 MB); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, PERMUTATIONS * 4), dtype=np.uint64) * U(2) + U(1)
#: Codes of two bits in a 64-bit word of a sketch.
_CODES = 32
#: 64-bit words of a parity map.
_PARITY = 16


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each text, A-Z lower-cased; the whole text's where it has fewer words."""
    raw, offsets = text_bytes(texts)
    w = Words(raw, offsets, lower=True)
    h = w.hashes()
    g = grams(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Both the least and the greatest value of each set under each permutation, as 32-bit fingerprints."""
    out = np.zeros((len(sets), 2 * permutations), np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        v = np.empty_like(x)
        with np.errstate(over="ignore"):
            for p in range(permutations):
                np.bitwise_xor(x, _SEEDS[0, p], out=v)
                v *= _SEEDS[1, p]
                for j, f in enumerate((np.minimum, np.maximum)):
                    out[full, 2 * p + j] = (mix(f.reduceat(v, at)) >> U(32)).astype(np.uint32).view(np.int32)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of rows values."""
    out = np.zeros((len(sig), sig.shape[1] // rows), U)
    with np.errstate(over="ignore"):
        for b in range(out.shape[1]):
            h = np.full(len(sig), b + 1, U)
            for r in range(rows):
                h = mix((h ^ sig[:, b * rows + r].view(np.uint32)) * U(0x9E3779B97F4A7C15))
            out[:, b] = h
    return out.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each value, in 64-bit words."""
    words = -(-sig.shape[1] // _CODES)
    out = np.zeros((len(sig), words), U)
    for i in range(sig.shape[1]):
        out[:, i // _CODES] |= (sig[:, i] & 3).astype(U) << U(2 * (i % _CODES))
    return out.view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each of 64 * _PARITY classes of hashes, whether a set has an odd number of them (an odd sketch)."""
    n, bits = len(sets), 64 * _PARITY
    out = np.zeros((n, bits), np.uint8)
    if n:
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        at = (np.concatenate(sets) & U(bits - 1)).astype(np.int64)
        out = (np.bincount(row * bits + at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(out, axis=1).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def signatures(docs: DataFrame, shingle: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, keys (of the bands), sketch, parity for each row of docs."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 1 << 20):
            sets = shingle_sets(b.column(1), shingle)
            sig = min_max(sets, permutations)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists(band_keys(sig, rows)), _lists(sketches(sig)), _lists(parities(sets))], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>, parity array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(small_batches(batches, "ta"), "tb"):
            texts = pa.concat_arrays([b.column(2), b.column(3)]).fill_null("").dictionary_encode()  # an id may have several
            sets, at = shingle_sets(texts.dictionary, shingle), texts.indices.to_numpy()
            ok = []
            for x, y in zip(at[: b.num_rows].tolist(), at[b.num_rows :].tolist(), strict=True):
                p, q = sets[x], sets[y]
                both = np.concatenate((p, q))
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                ok.append(100 * n >= percent * (len(both) - n))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    t = texts.select("id", "text")
    rows = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def _likely(x: str, y: str, percent: int, permutations: int) -> Column:
    """Whether n, parity and sketch of x and y leave it open that two sets reach the threshold.

    Parity maps differ in no more places than the sets do, and a pair at the threshold differs in (100 - percent) /
    (100 + percent) of both sizes at most: this part is exact, and sharp for sets of up to some thousands. Sketches
    are an estimate with a margin of SIGMAS standard errors.
    """
    values = 2 * permutations
    j = percent / 100 + (1 - percent / 100) / 4  # equal values have equal codes, others one time in four
    most = values - values * j + SIGMAS * (values * j * (1 - j)) ** 0.5
    even = 0x5555555555555555

    def differ(i: int) -> Column:
        d = F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(even)))

    words = -(-values // _CODES)
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(1, _PARITY)), F.bit_count(F.col(f"{x}.parity")[0].bitwiseXOR(F.col(f"{y}.parity")[0])))
    sets = (100 + percent) * apart <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    return sizes & sets & (sum((differ(i) for i in range(1, words)), differ(0)) <= F.lit(int(most)))


def _among(pairs: DataFrame, reps: DataFrame, percent: int, permutations: int) -> DataFrame:
    """Pairs (a, b) that ``_likely`` doesn't rule out."""
    r = reps.select("id", "n", "sketch", "parity")
    x, y = r.withColumnRenamed("id", "a").alias("x"), r.withColumnRenamed("id", "b").alias("y")
    return pairs.join(x, "a").join(y, "b").where(_likely("x", "y", percent, permutations)).select("a", "b")


def _between(rest: DataFrame, reps: DataFrame, percent: int, permutations: int) -> DataFrame:
    """Likely pairs (a, b) of different components in one bucket. rest: key, id, component.

    Buckets beyond LARGE members are cut into blocks by hash of the id, and each pair of blocks is a group of its own
    in the join: all pairs of different components are compared, none left out.
    """
    cuts = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(LARGE)).cast("int").alias("cuts")).where("cuts > 1")
    own = F.pmod(F.xxhash64("id", "key"), F.coalesce("cuts", F.lit(1))).cast("int")
    dealt = rest.join(cuts, "key", "left").withColumn("last", F.coalesce("cuts", F.lit(1)) - 1).withColumn("own", own).drop("cuts")
    now = table(dealt.join(reps.select("id", "n", "sketch", "parity"), "id"), "rest")
    x = now.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", "last"))).alias("x")
    y = now.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).alias("y")
    together = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.component") < F.col("y.component")) | ((F.col("x.i") < F.col("x.j")) & (F.col("x.component") > F.col("y.component")))
    pairs = x.join(y, together & once & _likely("x", "y", percent, permutations))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS, pivots: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) for each row of docs (doc_id, text).

    Documents are linked if 100 * |A & B| >= percent * |A | B| of their shingle sets. One with no words has an empty
    set and no links. Rows without an id have neither links nor a component and are kept; rows that share an id are one
    document with several texts. Equal sets are one class from the start, whatever their number. Signatures of
    2 * permutations values are cut into bands of rows values; classes that share a band are compared: first with the
    bucket's least member and with others by hash (pivots), then, in buckets that still hold several components, with
    all of other components, where sizes, parities and sketches inside the join rule out nearly all. So copies of one text cost a
    comparison each. Computed for independent values, a pair at the threshold shares none of 24 bands of 4 with
    probability 2.0e-8 at 85 and 3.2e-6 at 80 percent, and is ruled out by its sketches with 4.9e-6 and 5.9e-6.
    """
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark) as keep:
        sigs = keep(table(signatures(docs, shingle, permutations, rows), "signatures"))
        first = F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "keys", "sketch", "parity")).alias("r")
        reps = keep(table(sigs.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(first).select("digest", "r.*"), "classes"))
        dealt = reps.select("id", F.explode("keys").alias("key"))
        hubs = dealt.groupBy("key").agg(F.min("id").alias("p0"), F.max("id").alias("last")).where("p0 <> last")
        held = table(dealt.join(hubs.select("key", "p0"), "key"), "buckets")

        def confirmed(pairs: DataFrame) -> DataFrame:
            ids = table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
            few = ids.count() <= MOST_BROADCAST
            texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
            return _confirm(pairs, table(texts, "candidate_texts"), shingle, percent)

        tried = table(held.where("id <> p0").select(F.least("id", "p0").alias("a"), F.greatest("id", "p0").alias("b")).distinct(), "tried")
        links = table(confirmed(table(_among(tried, reps, percent, permutations), "likely")), "links")
        for turn in range(1, pivots + 2):
            comp = table(components(links), "components")
            now = held.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
            split = now.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key", F.when(F.xxhash64(F.lit(turn), "c0") < F.xxhash64(F.lit(turn), "c1"), F.col("c0")).otherwise(F.col("c1")).alias("c"))
            rest = table(now.join(split, "key"), "split")
            per = rest.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"), F.sum("n").alias("n"))
            left = per.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
            if not left["n"]:
                break
            last = turn > pivots or left["pairs"] <= 8 * left["n"]
            if not last:  # one component of the bucket, its member least by hash, against all others
                hub = rest.where("component = c").groupBy("key").agg(F.min_by("id", F.xxhash64(F.lit(turn), "id")).alias("hub"))
                more = rest.where("component <> c").join(hub, "key").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
                more = table(more.distinct().join(tried, ["a", "b"], "left_anti"), "more")
                tried = tried.union(more)
                likely = table(_among(more, reps, percent, permutations), "likely")
            else:
                likely = table(_between(rest.select("key", "id", "component"), reps, percent, permutations).distinct().join(tried, ["a", "b"], "left_anti"), "likely")
            links = table(links.union(confirmed(likely)), "links")
            if last:
                comp = table(components(links), "components")
                break
        keep(comp)
    named = reps.join(comp, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = sigs.join(named, (sigs["digest"] == named["digest"]) & (sigs["n_shingles"] > 0) & sigs["doc_id"].isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row, of the smallest id, of each group that ``near_duplicates`` links, and of equal id and text.

    Where ids repeat, each id and text is a document of its own, so that a text doesn't go for another text of its id.
    Rows without an id stay.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = free_name(docs, "_gone")
        out = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
        return docs.join(out, F.col("doc_id") == F.col(gone), "left_anti")
    one = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_one")
    digest = F.coalesce(F.sha2("text", 256), F.lit("")).alias("_digest")
    rows = named.groupBy("doc_id", digest).agg(one).orderBy("doc_id", "_digest")
    rows = table(rows.select(F.monotonically_increasing_id().alias("_node"), "_one"), "rows")  # numbers in the order of ids
    out = near_duplicates(rows.select(F.col("_node").alias("doc_id"), "_one.text"), shingle, percent).where("not kept").select(F.col("doc_id").alias("_gone"))
    kept = rows.join(out, F.col("_node") == F.col("_gone"), "left_anti").select("_one.*")
    return kept.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)
