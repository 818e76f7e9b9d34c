"""Operator 7: passages of benchmark items in training documents, by a generalised suffix automaton of the items."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.automaton import LOT_BYTES, SuffixAutomaton, lots, shards
from engram.llm.common import documents, scratch, ship, small_batches, table, text_bytes, tidy, total_bytes
from engram.llm.words import ALNUM, Words, grams

#: Bytes of item texts in one automaton, some 50,000 words and 25 MB in a worker; one item at least.
SHARD_BYTES = 300_000


class Items:
    """A generalised suffix automaton of some items, with the items' ids on its states.

    A window of an item is a substring of so many words, or all of an item of fewer. The state of a window knows the
    items that have it, since a state's substrings end at the same places.
    """

    def __init__(self, window: int, items: list[tuple[str, str]]):
        self.window, self.automaton = window, SuffixAutomaton()
        texts = [self._words(text) for _, text in items]
        for w in texts:
            self.automaton.add(w)
        size = len(self.automaton)
        of: list[frozenset[str] | None] = [None] * size
        short: list[frozenset[tuple[int, str]] | None] = [None] * size
        for (item, _), w in zip(items, texts, strict=True):
            k = min(window, len(w))
            for n, v in self.automaton.follow(w, k) if k else ():
                if n == k:
                    if k == window:
                        of[v] = (of[v] or frozenset()) | {item}
                    else:
                        short[v] = (short[v] or frozenset()) | {(k, item)}
        self.of, self.short = dict((v, x) for v, x in enumerate(of) if x), dict((v, x) for v, x in enumerate(short) if x)
        self.least = min((min(window, len(w)) for w in texts if w), default=window)
        # pairs of neighbours, and lone words of items of one word: no match of two words has others
        pairs: set[int] = set()
        lone: set[int] = set()
        for _, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            h = Words(raw, np.array([0, len(raw)]), ALNUM, lower=True).hashes()
            (pairs if len(h) > 1 else lone).update(grams(h, 2).tolist() if len(h) > 1 else h.tolist())
        self.pairs, self.lone = (np.array(sorted(x), np.uint64) for x in (pairs, lone))

    @staticmethod
    def _words(text: str) -> list[bytes]:
        raw = np.frombuffer(text.encode(), np.uint8)
        w = Words(raw, np.array([0, len(raw)]), ALNUM, lower=True)
        return [w.bytes_of(i) for i in range(len(w))]

    def _live(self, w: Words) -> np.ndarray:
        """Words that may be part of a match of two words, or are an item of one."""
        h = w.hashes()
        live = _among(h, self.lone)
        pair = _among(grams(h, 2), self.pairs)
        live[:-1] |= pair
        live[1:] |= pair
        return live

    def find(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Words that are hit, and by row the items found there. Runs of live words pass through the automaton."""
        hit = np.zeros(len(w), bool)
        items: dict[int, set[str]] = {}
        if not len(w):
            return hit, items
        live = self._live(w)
        edge = np.diff(np.concatenate(([0], live.astype(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = w.first[1:-1]  # runs end with their row
        cut = inner[(inner > 0) & (inner < len(w))]
        cut = cut[live[np.minimum(cut, len(w) - 1)] & live[cut - 1]]
        first, last = np.sort(np.append(first, np.unique(cut))), np.sort(np.append(last, np.unique(cut)))
        long = last - first >= self.least
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            tokens = [w.bytes_of(i) for i in range(a, b)]
            for j, (n, v) in enumerate(self.automaton.follow(tokens, self.window), a + 1):
                if n == self.window and v in self.of:
                    hit[j - n : j] = True
                    items.setdefault(int(w.doc[a]), set()).update(self.of[v])
                while self.short and v:
                    for k, item in self.short.get(v, ()):
                        if k <= n:
                            hit[j - k : j] = True
                            items.setdefault(int(w.doc[a]), set()).add(item)
                    v = self.automaton.link[v]
        return hit, items


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def automata(benchmark: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """shard, made (a pickled ``Items``) of the items dealt to shards by their ids; built on the executors."""

    def make(names: list[str | None], texts: list[str]) -> bytes:
        return pickle.dumps(Items(window, list(zip(names, texts, strict=True))))

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("name"), "text")
    return shards(items, max(1, -(-total_bytes(items) // shard_bytes)), make)


def _without(w: Words, first: int, text: np.ndarray, start: int, spans: list[dict]) -> str:
    """A text, whose bytes begin at start of w's and whose words at first, without spans of words."""
    keep = np.ones(len(text), bool)
    for x in spans:
        keep[int(w.start[first + x["start"]]) - start : int(w.end[first + x["stop"] - 1]) - start] = False
    return text[keep].tobytes().decode()


def _pass(df: DataFrame, made: list[bytes], cut: int | None) -> DataFrame:
    """What pickled Items add to _hits and _items; with cut, _text comes without hit spans of at least so many words."""
    shared = df.sparkSession.sparkContext.broadcast(made)
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "items" not in cache:
            cache["items"] = [pickle.loads(x) for x in shared.value]
        for b in small_batches(batches, "_text"):
            raw, offsets = text_bytes(b.column(b.schema.get_field_index("_text")))
            w = Words(raw, offsets, ALNUM, lower=True)
            hit, by_row = np.zeros(len(w), bool), {}
            for part in cache["items"]:
                more, names_of = part.find(w)
                hit |= more
                for r, names in names_of.items():
                    by_row.setdefault(r, set()).update(names)
            old_hits, old_items = b.column(b.schema.get_field_index("_hits")), b.column(b.schema.get_field_index("_items"))
            hits, names = [[]] * b.num_rows, [[]] * b.num_rows
            touched = set(by_row) | set(np.flatnonzero(np.asarray(old_hits.value_lengths()) > 0).tolist())
            for r in touched:
                a, z = int(w.first[r]), int(w.first[r + 1])
                own = hit[a:z].copy()
                for x in old_hits[r].as_py():
                    own[x["start"] : x["stop"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                hits[r] = [{"start": int(s), "stop": int(t)} for s, t in edge.reshape(-1, 2)]
                names[r] = sorted(by_row.get(r, set()) | set(old_items[r].as_py()))
            texts = b.column(b.schema.get_field_index("_text"))
            if cut is not None and touched:
                long = {r: [x for x in hits[r] if x["stop"] - x["start"] >= cut] for r in touched}
                texts = pa.array([_without(w, int(w.first[r]), raw[offsets[r] : offsets[r + 1]], int(offsets[r]), long[r]) if long.get(r) else texts[r].as_py() for r in range(b.num_rows)], texts.type)
            columns = {"_text": texts, "_words": pa.array(np.diff(w.first)), "_hits": pa.array(hits, old_hits.type), "_items": pa.array(names, old_items.type)}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], schema=b.schema)

    return df.mapInArrow(tidy(run), df.schema)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 8, shard_bytes: int = SHARD_BYTES, lot_bytes: int = LOT_BYTES, cut: int | None = None) -> DataFrame:
    """Each row of docs (as struct _row) with _words (count), _hits (merged ranges of hit words), _items (item ids).

    cut: _row has all columns, and _text is the text without hit spans of at least so many words; by default _row has
    the id only. The last pass cuts, so that a task keeps one Python worker and sends it each text once.

    Texts: A-Z lower-cased, words of digits, a-z and characters beyond ASCII. A window is so many consecutive words of
    an item; an item of fewer, but not none, is one window. Nulls have no words; items without an id are left out;
    equal ids are one item. Items are dealt to shards of about shard_bytes of text, whose automata are built on the
    executors and broadcast in lots of at most lot_bytes (pickled; one shard at least). A lot is one pass over docs;
    between passes what is found so far is written to the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    df = docs.select(
        F.struct(*([c for c in docs.columns] if cut is not None else ["doc_id"])).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"), F.lit(0).cast("long").alias("_words"),
        F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)").alias("_hits"), F.expr("cast(array() as array<string>)").alias("_items"),
    )
    with scratch(spark) as keep:
        made = table(automata(benchmark, window, shard_bytes), "item_automata")
        rest = lots(made, "made", lot_bytes)
        now = next(rest)
        for following in rest:
            df, now = table(_pass(df, [bytes(r["made"]) for r in now], None), "passages"), following
        if hasattr(df, "written_at"):
            keep(df)  # the last pass, below, reads it
        return _pass(df, [bytes(r["made"]) for r in now], cut)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2, shard_bytes: int = SHARD_BYTES, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated (n_items >= least_items)."""
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return find_passages(docs, benchmark, window, shard_bytes, lot_bytes).select("_row.doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), (F.size("_items") >= least_items).alias("contaminated"))


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_span: int = 8, most_coverage: float = 0.5) -> DataFrame:
    """docs without hit spans of at least least_span words, and without documents whose hit share is over most_coverage.

    A span goes from its first word's first byte to its last word's last. Rows with no span stay byte for byte; nulls
    stay null. Columns as docs has them; n_chars, if there, follows the text.
    """
    found = find_passages(docs, benchmark, window, cut=least_span)
    size = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    rows = found.where(size <= F.lit(most_coverage) * F.col("_words"))
    is_cut = F.exists("_hits", lambda x: x["stop"] - x["start"] >= least_span)
    new = {"text": F.when(is_cut, F.col("_text")).otherwise(F.col("_row.text")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(is_cut, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")).alias("n_chars")
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`").alias(c)) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
