"""Operator 5: URL rules with a cascade of Bloom filters over the corpus's own keys."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.automaton import lots
from engram.llm.common import scratch, ship, table, tidy

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BITS_PER_KEY, HASHES = 12, 8
#: Keys of the universe that one cascade is made over, in one task.
SLICE_KEYS = 200_000
#: Bytes of cascades that are broadcast at a time; more take more scans of the pages, each for the slices it has.
PASS_BYTES = 64 << 20
_BLOB = "slice long, cascade binary"


@dataclass(frozen=True)
class Cascade:
    """levels[0] holds the listed keys, levels[1] the others that pass it, levels[2] the listed that pass that, ...

    same: for hashes that a listed key and another share, the listed keys themselves.
    """

    levels: tuple[np.ndarray, ...]
    same: dict[tuple[int, int], frozenset[str]]

    @staticmethod
    def over(h: np.ndarray, g: np.ndarray, listed: np.ndarray, keys: list[str]) -> Cascade:
        """h, g: two hashes of each distinct key; listed: whether it is; keys: their texts. These are the universe."""
        pair = g >> 1  # the lowest bit has no say in places
        order = np.lexsort((pair, h))
        twin = (h[order][1:] == h[order][:-1]) & (pair[order][1:] == pair[order][:-1])
        shared = np.zeros(len(h), bool)
        shared[order[1:][twin]] = shared[order[:-1][twin]] = True
        same: dict[tuple[int, int], set[str]] = {}
        for i in np.flatnonzero(shared).tolist():
            same.setdefault((int(h[i]), int(pair[i])), set()).update([keys[i]] if listed[i] else [])
        live = [np.flatnonzero(~shared & ~listed), np.flatnonzero(~shared & listed)]
        levels: list[np.ndarray] = []
        while len(now := live[(len(levels) + 1) % 2]):
            i, other = len(levels), len(levels) % 2
            level = np.zeros(64 * max(1, math.ceil(len(now) * BITS_PER_KEY / 64)) // 8, np.uint8)
            at = _places(i, h[now], g[now], len(level) * 8).ravel()
            np.bitwise_or.at(level, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            live[other] = live[other][_test(level, i, h[live[other]], g[live[other]])]
            levels.append(level)
        return Cascade(tuple(levels), {k: frozenset(v) for k, v in same.items()})

    def has(self, h: np.ndarray, g: np.ndarray, keys) -> np.ndarray:
        """Whether each key is listed: exact for keys of the universe. keys(i): the text of the i-th."""
        out = np.zeros(len(h), bool)
        live = np.arange(len(h))
        for i, level in enumerate(self.levels):
            ok = _test(level, i, h[live], g[live])
            out[live[~ok]] = i % 2 == 1
            live = live[ok]
        out[live] = len(self.levels) % 2 == 1
        if self.same:
            for i, pair in enumerate(zip(h.tolist(), (g >> 1).tolist(), strict=True)):
                if pair in self.same:
                    out[i] = keys(i) in self.same[pair]
        return out


def _places(level: int, h: np.ndarray, g: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h, g = h.astype(np.uint64), g.astype(np.uint64) | np.uint64(1)
        h = (h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        g = g + np.uint64(2 * level) * (h | np.uint64(1))  # another stride at each level too
        return (h[:, None] + g[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def _test(level: np.ndarray, i: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, bool)
    at = _places(i, h, g, len(level) * 8)
    return ((level[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_cascades(keys: DataFrame) -> DataFrame:
    """slice, cascade of keys (slice, h, g, listed, key), which are distinct and the whole universe; a task for each slice."""
    ship(keys.sparkSession)

    def build(t: pa.Table) -> pa.Table:
        h, g = (t.column(c).to_numpy() for c in ("h", "g"))
        made = Cascade.over(h, g, np.asarray(t.column("listed").to_numpy(zero_copy_only=False), bool), t.column("key").to_pylist())
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int64()), "cascade": pa.array([pickle.dumps(made)], pa.binary())})

    return keys.select("slice", "h", "g", "listed", "key").groupBy("slice").applyInArrow(build, _BLOB)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL as text; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _winner(rules, host: Column, path: Column, part: int) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is tested first
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, F.lit(r[0] + r[1] if part == 0 else r[2])).otherwise(out)
    return out


def judge(pages: DataFrame, rules=RULES, slice_keys: int = SLICE_KEYS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url); other columns are ignored.

    rules: (host, path, allow or block). One fits its host and all subdomains where the path begins with its own; the
    longest (host and path) wins. A key is a host and as much of a path as rules tell apart; keys that a block rule wins
    are listed. The distinct keys of the corpus are the universe, written once and cut by hash into slices of about
    slice_keys; a cascade for each is made in a task of its own. Their verdict on a page: block if listed, else allow,
    also where no rule fits. Cascades are broadcast in lots of at most pass_bytes, and pages are scanned once a lot, so
    what a worker holds is bounded at any number of keys. Keys that share both their hashes are told apart by their text.
    Null and odd URLs have an empty host and path, equal rows equal results, and an empty table no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = host_and_path()
    depth = max((r[1].count("/") for r in rules), default=1)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    head = F.regexp_extract("path", "^((?:[^/]*/){0,%d}[^/]*)" % depth, 1)
    head = F.when(F.size(F.split("path", "/")) > depth, F.regexp_extract("path", "^((?:[^/]*/){%d})" % depth, 1)).otherwise(head)
    rows = rows.withColumn("head", head)
    rows = rows.withColumn("h", F.xxhash64("host", "head")).withColumn("g", F.xxhash64(F.lit(1), "head", "host"))
    listed = F.coalesce(_winner(rules, F.col("host"), F.col("head"), 1) == "block", F.lit(False))
    key = F.concat_ws("\n", "host", "head")
    with scratch(spark) as keep:
        universe = table(rows.select("host", "head", "h", "g").dropDuplicates(["host", "head"]).select("h", "g", key.alias("key"), listed.alias("listed")), "url_keys")
        n = max(1, -(-universe.count() // slice_keys))
        slice_of = F.pmod(F.xxhash64(F.lit(2), "h", "g"), F.lit(n))
        made = keep(table(build_cascades(universe.withColumn("slice", slice_of)), "url_cascades"))
    rule = _winner(rules, F.col("host"), F.col("path"), 0)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), "h", "g", slice_of.alias("slice"), key.alias("key"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def with_lot(lot: dict[int, bytes]) -> DataFrame:
        shared = spark.sparkContext.broadcast(lot)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, Cascade] = {}
            for b in batches:
                h, g, slices, keys = (b.column(i) for i in range(4, 8))
                h, g, slices = h.to_numpy(), g.to_numpy(), slices.to_numpy()
                found = np.zeros(b.num_rows, bool)
                for s in np.unique(slices).tolist():
                    if s not in known:
                        known[s] = pickle.loads(shared.value[s])
                    mine = np.flatnonzero(slices == s)
                    found[mine] = known[s].has(h[mine], g[mine], lambda i, mine=mine, keys=keys: keys[int(mine[i])].as_py())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.where(found, "block", "allow"), pa.string())], ["page_id", "host", "path", "rule", "verdict"])

        mine = rows if n == 1 else rows.where(F.col("slice").isin(list(lot)))
        return mine.mapInArrow(tidy(look_up), f"page_id {kind}, host string, path string, rule string, verdict string")

    parts = [with_lot({r["slice"]: bytes(r["cascade"]) for r in lot}) for lot in lots(made, "cascade", pass_bytes)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("page_id", "host", "path", "rule", "verdict")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
