"""Operator 1: toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import documents, ship, small_batches, tidy

BUCKETS = 1 << 20
#: Bounds on what the driver fits on: documents of either kind, and features of the model.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 3000, 9000, 3000
#: Least surplus of a feature, about one chance in ten million: a million buckets are looked at.
SURE = 28.0
#: Parts of the fitted rows by which the cut is chosen.
FOLDS = 3
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hash buckets of a word and its beginnings of 4, 5 and 6 letters, each marked by its kind."""
    out = [zlib.crc32(b"w" + word.encode())]
    out += [zlib.crc32(b"p" + word[:k].encode()) for k in (4, 5, 6) if len(word) >= k]
    return [x % BUCKETS for x in out]


class _Known(dict):
    """Features by word; forgets all when full."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.make(word)
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no model sees: crc32 of the id as text leaves 1 by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of the weights of distinct features present); features are hash buckets."""

    weights: dict[int, float]
    bias: float
    prior: float

    def scorer(self):
        get = self.weights.get

        def of(word: str) -> frozenset[int] | None:
            own = [f for f in word_features(word) if f in self.weights]
            return frozenset(own) if own else None

        known = _Known(of)

        def score(text: str) -> float:
            seen: set[int] = set()
            for own in set(map(known.__getitem__, set(_WORD.findall(text.lower())))):
                if own:
                    seen |= own
            z = self.bias + sum(get(f) for f in sorted(seen))
            return 1 / (1 + np.exp(-min(max(z, -35.0), 35.0)))

        return score


def fit_nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, epochs: int = 300, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model under the non-negative risk, with logistic loss and Adam.

    Risk: prior * R_p(+) + max(-beta, R_u(-) - prior * R_p(-)). Where the second part falls below -beta, the step goes
    up its gradient instead, which stops the model from fitting the unlabelled positives as negatives.
    """
    rng = np.random.Generator(np.random.PCG64(3))
    w, b = np.zeros(x_pos.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    step = 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    softplus = lambda z: np.logaddexp(0, z)
    for _ in range(epochs):
        p = x_pos[rng.permutation(len(x_pos))[:1000]].astype(np.float64)
        u = x_unl[rng.permutation(len(x_unl))[:3000]].astype(np.float64)
        zp, zu = p @ w + b, u @ w + b
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        gp, gu = np.zeros(len(p)), np.zeros(len(u))
        if negative >= -beta:
            gp += prior * (sigmoid(zp) - 1) / len(p) - prior * sigmoid(zp) / len(p)
            gu += sigmoid(zu) / len(u)
        else:
            gp += prior * sigmoid(zp) / len(p)
            gu -= sigmoid(zu) / len(u)
        g = np.append(p.T @ gp + u.T @ gu + decay * w, gp.sum() + gu.sum())
        step += 1
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return w, float(b)


def best_cut(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> float:
    """The logit from which on to call a text toxic: the middle of the widest run of cuts of least risk.

    The risk of a cut is the corrected one of positive-unlabelled learning, with errors counted: prior * missed
    positives + the unlabelled above it - prior * found positives. It isn't cut off at 0 here: then a lower cut that
    finds nothing more would cost nothing. The logits must come from models that were fitted without these rows.
    """
    z = np.unique(np.concatenate((z_pos, z_unl)))
    cuts = np.append((z[1:] + z[:-1]) / 2, z[-1] + 1) if len(z) else np.zeros(1)
    missed = np.searchsorted(np.sort(z_pos), cuts) / max(len(z_pos), 1)
    above = 1 - np.searchsorted(np.sort(z_unl), cuts) / max(len(z_unl), 1)
    risk = above + 2 * prior * missed
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    wide = max(runs, key=lambda r: cuts[r[-1]] - cuts[r[0]])
    return float((cuts[wide[0]] + cuts[wide[-1]]) / 2)


def _surplus(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Likelihood ratio (G) of each feature being as frequent in both samples; 0 where it isn't more so in the first."""

    def part(x, share, size):
        return x * np.log(np.maximum(x, 1e-9) / np.maximum(share * size, 1e-9))

    share = (a + b) / (n + m)
    g = 2 * (part(a, share, n) + part(b, share, m) + part(n - a, 1 - share, n) + part(m - b, 1 - share, m))
    return np.where((a / n > b / m) & (a >= 3), g, 0.0)


def _fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, most_features: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Features (buckets) that positives have more often than chance has it, their weights, and the bias."""
    in_pos, in_unl = (np.bincount(np.concatenate(x), minlength=BUCKETS) for x in (pos, unl))
    gain = _surplus(in_pos, len(pos), in_unl, len(unl))
    best = np.argsort(-gain, kind="stable")[:most_features]
    best = np.sort(best[gain[best] >= SURE])
    w, b = fit_nnpu(_dense(pos, best), _dense(unl, best), prior)
    return best, w, b


def _dense(sets: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    place = np.full(BUCKETS, -1)
    place[features] = np.arange(len(features))
    x = np.zeros((len(sets), len(features)), np.float32)
    for i, s in enumerate(sets):
        p = place[s]
        x[i, p[p >= 0]] = 1
    return x


def _cut_by_folds(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, most_features: int, folds: int) -> float | None:
    """``best_cut`` over logits of the training rows, each from a model that didn't see its fold; None with too few rows."""
    if min(len(pos), len(unl)) < 2 * folds:
        return None
    out: list[list[np.ndarray]] = [[], []]
    for k in range(folds):
        used = [[s for i, s in enumerate(x) if i % folds != k] for x in (pos, unl)]
        features, w, b = _fit(used[0], used[1], prior, most_features)
        for z, x in zip(out, (pos, unl), strict=True):
            z.append(_dense(x[k::folds], features) @ w + b)
    return best_cut(np.concatenate(out[0]), np.concatenate(out[1]), prior)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_features: int = MOST_FEATURES, threshold: float = 0.7, folds: int = FOLDS) -> Model:
    """Fits on at most most_positive toxic and most_unlabelled other documents, chosen by hash of their ids.

    All logits are then shifted so that threshold stands at the cut of least risk, as cross-validation inside the same
    rows finds it; rows held out have no part in it.

    Of the labels only rows that ``held_out`` doesn't name count: their toxic ones are the positives, and their share
    is the class prior; the unlabelled are any documents not held out that aren't among the positives. Rows without
    id or label don't count. With no positive, every score is near 0.
    """
    spark = docs.sparkSession
    ship(spark)
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = seen.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    if not counts["p"]:
        return Model({}, -6.0, 0.0)
    prior = min(max(counts["p"] / counts["n"], 1e-4), 0.95)
    order = F.xxhash64(F.lit(5), "doc_id")
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct().join(seen.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")), "doc_id", "left")
    take = ids.where("positive").orderBy(order, "doc_id").limit(most_positive).union(ids.where("positive is null").orderBy(order, "doc_id").limit(most_unlabelled))
    chosen = [(r["doc_id"], r["positive"] or False) for r in take.collect()]  # at most most_positive + most_unlabelled
    picked = spark.createDataFrame(chosen, "doc_id long, positive boolean")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(word_features)
        for b in small_batches(batches, "text"):
            out = [np.unique(np.fromiter((f for w in set(_WORD.findall(t.lower())) for f in known[w]), np.int32)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["positive", "features"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("positive", "text").mapInArrow(tidy(features), "positive boolean, features binary")
    got = [(r["positive"], np.frombuffer(r["features"], np.int32)) for r in rows.toLocalIterator()]
    got = sorted({(p, f.tobytes()) for p, f in got}, key=lambda x: (x[0], zlib.crc32(x[1]), x[1]))  # copies count once; folds cut this order
    got = [(p, np.frombuffer(f, np.int32)) for p, f in got]
    pos, unl = [f for p, f in got if p], [f for p, f in got if not p]
    if not pos or not unl:
        return Model({}, -6.0, prior)
    features_of, w, b = _fit(pos, unl, prior, most_features)
    cut = _cut_by_folds(pos, unl, prior, most_features, folds)
    if cut is not None:
        b += float(np.log(threshold / (1 - threshold))) - cut
    return Model({int(f): float(x) for f, x in zip(features_of, w, strict=True) if x}, b, prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for each row; a null text is empty."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([float(of(t or "")) for t in b.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows of docs that aren't toxic, as they are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in small_batches(batches, "text"):
            yield b.filter(pa.array([of(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
