"""Operator 3: removal of passages that the corpus has had before, decided by suffix automata of reference passages.

``remove_repeats`` takes the corpus as its own reference. Automata of all its shards, streamed past all its documents,
would make the work grow with the square of the corpus; so fingerprints of blocks of windows first route passages that
may repeat to shards of reference passages, and each shard's automaton meets those passages alone.
``against_reference`` is for a given set of references: automata of all of them, broadcast in lots.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.automaton import LOT_BYTES, SuffixAutomaton, lots, shards
from engram.llm.common import documents, ids_of, scratch, ship, small_batches, table, text_bytes, tidy, total_bytes
from engram.llm.words import U, Words, grams, lowest, mix, ranges

#: Text of one shard of documents.
SHARD_BYTES = 2 << 20
#: Text of references in one automaton, some 50,000 words.
REFERENCE_BYTES = 300_000
#: Words of passages in one automaton of the routed form; the passages of one key stay together.
LOT_WORDS = 20_000
#: Texts of one key that are judged together; the windows of keys with more are judged one by one.
MOST_TEXTS = 64
GONE, MIXED, SPLIT = 1, 2, 3


class _Shard:
    """The documents of a shard, their windows, and the blocks of windows that have the same lowest k-gram."""

    def __init__(self, docs: pa.Table, window: int, k: int):
        text = docs.column("text").to_pandas() if docs.num_rows else None
        ids = ids_of(docs.column("doc_id"))
        if docs.num_rows:  # the order in which rows arrive may differ from run to run
            order = np.lexsort((np.array([hash_of(x) for x in text], U), ids))
            docs, ids = docs.take(pa.array(order)), ids[order]
        self.docs, self.ids, self.window = docs, ids, window
        raw, offsets = text_bytes(docs.column("text"))
        self.words = w = Words(raw, offsets)
        h = w.hashes()
        n = len(w) - window + 1
        self.at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.doc = w.doc[self.at]
        self.key = grams(h, window)[self.at] if n > 0 else np.zeros(0, U)
        with np.errstate(over="ignore"):
            self.check = mix(grams(mix(h), window)[self.at]) if n > 0 else np.zeros(0, U)
            low = lowest(grams(h, k), window - k + 1)[self.at] if len(self.at) else np.zeros(0, U)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (self.doc[1:] != self.doc[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(low)))
            self.block_first, self.block_size = first, size
            self.block_key = mix(low[first])
            sums = np.zeros(len(low) + 1, U)
            np.cumsum(mix(self.check ^ (self.key * U(0x9E3779B97F4A7C15))) * (np.arange(len(low), dtype=U) * U(2) + U(1)), out=sums[1:])
            # a block's check hashes its windows in order: sum of hash * (2 * place in the block + 1)
            plain = np.zeros(len(low) + 1, U)
            np.cumsum(mix(self.check ^ (self.key * U(0x9E3779B97F4A7C15))), out=plain[1:])
            last = first + size
            self.block_check = mix((sums[last] - sums[first]) - (plain[last] - plain[first]) * (first.astype(U) * U(2)) + size.astype(U)) | U(1)
        self.block_doc = self.doc[first]

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By block key: keys, the check (0 where blocks differ), the smallest id, the number of different blocks."""
        order = np.lexsort((self.block_check, self.block_key))
        keys, checks, ids = self.block_key[order], self.block_check[order], self.ids[self.block_doc[order]]
        if not len(keys):
            return keys, checks, ids, np.zeros(0, np.int32)
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        texts = np.add.reduceat((new | np.append(True, checks[1:] != checks[:-1])).astype(np.int32), first)
        return keys[first], np.where(texts > 1, U(0), checks[first]), np.minimum.reduceat(ids, first), texts

    def alone(self, keys: np.ndarray) -> np.ndarray:
        """Windows (their numbers) of the blocks with these keys."""
        mine = np.flatnonzero(np.isin(self.block_key, keys)) if len(keys) else np.zeros(0, np.int64)
        return ranges(self.block_first[mine], self.block_size[mine])

    def within(self) -> np.ndarray:
        """For each window, whether its document has it earlier."""
        out = np.zeros(len(self.at), bool)
        with np.errstate(over="ignore"):
            k = mix(self.key + self.doc.astype(U) * U(0xD1342543DE82EF95))
        s = np.sort(k)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            some = np.flatnonzero(np.isin(k, twice))
            order = some[np.lexsort((some, self.check[some], self.key[some], self.doc[some]))]
            same = (self.doc[order][1:] == self.doc[order][:-1]) & (self.key[order][1:] == self.key[order][:-1]) & (self.check[order][1:] == self.check[order][:-1])
            out[order[1:][same]] = True
        return out

    def passages(self, mixed: np.ndarray, split: np.ndarray) -> list[_Passages]:
        """The blocks with keys in mixed, and the windows of those with keys in split."""
        b = np.flatnonzero(np.isin(self.block_key, mixed)) if len(mixed) else np.zeros(0, np.int64)
        w = self.alone(split)
        return [
            _Passages(self, self.block_key[b], self.block_check[b], self.ids[self.block_doc[b]], self.block_first[b], self.block_size[b]),
            _Passages(self, self.key[w], self.check[w] | U(1), self.ids[self.doc[w]], w, np.ones(len(w), np.int64)),
        ]

    def text(self, first: int, windows: int) -> bytes:
        """The text of so many windows from one on."""
        a = self.at[first]
        return self.words.raw[self.words.start[a] : self.words.end[a + windows + self.window - 2]].tobytes()


class _Passages:
    """Passages of a shard in groups of equal text (two hashes), each group's first being of the smallest id."""

    def __init__(self, s: _Shard, key: np.ndarray, check: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray):
        order = np.lexsort((ids, check, key))
        self.s = s
        self.key, self.check, self.ids, self.first, self.size = (x[order] for x in (key, check, ids, first, size))
        new = np.append(True, (self.key[1:] != self.key[:-1]) | (self.check[1:] != self.check[:-1])) if len(key) else np.zeros(0, bool)
        self.heads, self.group = np.flatnonzero(new), np.cumsum(new) - 1

    def rows(self, shard: int) -> pa.Table:
        h = self.heads
        texts = [self.s.text(a, n) for a, n in zip(self.first[h].tolist(), self.size[h].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(np.full(len(h), shard, np.int32)), pa.array(self.key[h].view(np.int64)), pa.array(self.check[h].view(np.int64)), pa.array(self.ids[h]), pa.array(texts, pa.binary())], schema=_TEXTS)

    def settle(self, gone: np.ndarray, answers: dict[tuple[int, int], tuple[int, np.ndarray]]) -> None:
        """Marks windows in gone. answers: by text, the smallest id that has it, and which of its windows that one's are gone."""
        if not len(self.key):
            return
        key, check = self.key.view(np.int64)[self.heads].tolist(), self.check.view(np.int64)[self.heads].tolist()
        got = [answers[x] for x in zip(key, check, strict=True)]
        least = np.array([x for x, _ in got], np.int64)[self.group]
        later = np.flatnonzero(self.ids > least)
        gone[ranges(self.first[later], self.size[later])] = True
        some = np.array([len(x) > 0 for _, x in got], bool)[self.group]
        for i in np.flatnonzero((self.ids == least) & some).tolist():
            gone[self.first[i] + got[self.group[i]][1]] = True


_TEXTS = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("check", pa.int64()), ("id", pa.int64()), ("text", pa.binary())])
_ENTRIES = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("check", pa.int64()), ("id", pa.int64()), ("texts", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_ANSWER = "shard int, key long, check long, what int, least long, gone array<int>"


def hash_of(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little")


def judge(passages: list[tuple[int, int, int, bytes]], window: int, most_words: int = LOT_WORDS) -> Iterator[tuple[int, int, int, list[int]]]:
    """key, check, id and the gone windows of (key, check, id, text), each text once with the smallest id that has it.

    A window is gone if a passage of its key with a smaller id has it too. The passages of some keys become a suffix
    automaton whose states know the smallest id that their substrings occur in; then each passage passes through it:
    where the longest match reaches window words, the state of its last so many words gives that window's smallest id.
    """
    passages = sorted(passages, key=lambda x: (x[0], x[2], x[1]))
    i = 0
    while i < len(passages):
        lot: list[tuple[int, int, int, list[bytes]]] = []
        n = 0
        while i < len(passages) and (n < most_words or passages[i][0] == passages[i - 1][0]):
            key, check, own, text = passages[i]
            lot.append((key, check, own, text.split()))
            n += len(lot[-1][3])
            i += 1
        automaton = SuffixAutomaton()
        for _, _, _, tokens in lot:
            automaton.add(tokens)
        least: list[int | None] = [None] * len(automaton)
        for _, _, own, tokens in lot:
            for _, v in automaton.follow(tokens):
                if least[v] is None or own < least[v]:
                    least[v] = own
        automaton.spread(least, min)
        for key, check, own, tokens in lot:
            yield key, check, own, [j - window + 1 for j, (m, v) in enumerate(automaton.follow(tokens, window)) if m == window and least[v] < own]


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 6, shard_bytes: int = SHARD_BYTES, most_texts: int = MOST_TEXTS) -> DataFrame:
    """Each document without the words of windows whose word sequence also starts earlier in the corpus.

    docs: doc_id, text; other columns are ignored. Returns one row per row of docs: doc_id, n_words, n_removed,
    kept_text (kept words joined by one space). Null and empty texts have no words; rows that share an id, or have
    none, are not earlier than each other; the same row twice gives the same result twice; an empty table gives none.

    Documents are dealt to shards by id, once. Windows with the same lowest k-gram form a block, whose k-gram is its
    key: equal windows have equal keys. Routing: each shard gives one row for each of its keys (the block's hash, or 0
    where its blocks differ; the smallest id), summed by key over all shards. Blocks of a key that are equal wherever
    it stands are gone but for the smallest id's. The other keys' passages, each text once, are dealt by key to shards
    of reference passages, where suffix automata decide (``judge``). A key with more than most_texts texts, such as the
    edge of a passage that a third of all documents have, sends windows dealt by their own hash. Sums and joins are
    by row, so a common key is summed where it lies and its join may be split; no group holds more than most_texts
    texts of a key. Texts count as equal when two 64-bit hashes agree; the automata compare words.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total_bytes(docs) // shard_bytes), 1)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(parts)).cast("int"))
    group = dealt.groupBy("shard")

    def ask_blocks(docs: pa.Table) -> pa.Table:
        keys, check, ids, texts = _Shard(docs, window, gram).blocks()
        shard = np.full(len(keys), docs.column("shard")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(x) for x in (shard, keys.view(np.int64), check.view(np.int64), ids, texts)], schema=_ENTRIES)

    def keys_of(answers: pa.Table, what: int) -> np.ndarray:
        mine = answers.column("what").to_numpy() == what
        return answers.column("key").to_numpy()[mine].view(U)

    def ask_texts(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _TEXTS.empty_table()
        made = _Shard(docs, window, gram).passages(keys_of(answers, MIXED), keys_of(answers, SPLIT))
        return pa.concat_tables([p.rows(docs.column("shard")[0].as_py()) for p in made])

    def judged(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("key", "check", "id", "text")), strict=True))
        out = list(zip(*judge(rows, window), strict=True))
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int32()))], ["key", "check", "least", "gone"])

    def settle(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table()
        s = _Shard(docs, window, gram)
        gone = s.within()
        gone[s.alone(keys_of(answers, GONE))] = True
        mixed, split = keys_of(answers, MIXED), keys_of(answers, SPLIT)
        keys, _, ids, _ = s.blocks()
        # blocks that are equal wherever they stand: all but those of the smallest id
        place = np.searchsorted(keys, s.block_key)
        later = np.flatnonzero(s.ids[s.block_doc] > ids[place]) if len(keys) else np.zeros(0, np.int64)
        later = later[~np.isin(s.block_key[later], np.concatenate((mixed, split)))]
        gone[ranges(s.block_first[later], s.block_size[later])] = True
        texts = answers.filter(pc.equal(answers.column("what"), 0))
        of = {(k, c): (n, np.array(g, np.int64)) for k, c, n, g in zip(*(texts.column(c).to_pylist() for c in ("key", "check", "least", "gone")), strict=True)}
        for p in s.passages(mixed, split):
            p.settle(gone, of)
        return _kept(s, gone)

    with scratch(spark) as keep:
        entries = table(group.applyInArrow(ask_blocks, "shard int, key long, check long, id long, texts int"), "blocks")
        shared = entries.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.min("id").alias("least"), F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("n"))
        differ = (F.col("low") != F.col("high")) | (F.col("low") == 0)
        shared = shared.where((F.col("n") > 1) | differ).select("key", "least", F.when(differ & (F.col("texts") > most_texts), SPLIT).when(differ, MIXED).otherwise(GONE).alias("what"))
        told = entries.join(shared, "key").where((F.col("what") > GONE) | (F.col("id") > F.col("least")))
        none = F.lit(None).cast("array<int>")
        told = keep(table(told.select("shard", "key", F.lit(0).cast("long").alias("check"), "what", F.lit(None).cast("long").alias("least"), none.alias("gone")), "told"))
        texts = table(group.cogroup(told.groupBy("shard")).applyInArrow(ask_texts, "shard int, key long, check long, id long, text binary"), "repeat_texts")
        once = texts.groupBy("key", "check").agg(F.min("id").alias("id"), F.first("text").alias("text")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
        by_text = once.groupBy("part").applyInArrow(judged, "key long, check long, least long, gone array<int>")
        answers = keep(table(texts.select("shard", "key", "check").join(by_text, ["key", "check"]).select("shard", "key", "check", F.lit(0).alias("what"), "least", "gone"), "judged"))
    return group.cogroup(told.unionByName(answers).groupBy("shard")).applyInArrow(settle, "doc_id long, n_words long, n_removed long, kept_text string")


def _kept(s: _Shard, gone: np.ndarray) -> pa.Table:
    w, rows = s.words, s.docs.num_rows
    edge = np.zeros(len(w) + 1, np.int64)
    at = s.at[gone]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + s.window, -1)
    texts, words, count = _without(w, np.cumsum(edge)[:-1] == 0, rows)
    return pa.Table.from_arrays([s.docs.column("doc_id").combine_chunks(), pa.array(words), pa.array(words - count), texts], schema=_OUT)


def _without(w: Words, keep: np.ndarray, rows: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """By row: the kept words joined by one space, the number of words, that of kept words."""
    count = np.bincount(w.doc[keep], minlength=rows)
    return join_words(w.raw, w.start[keep], w.end[keep], np.concatenate(([0], np.cumsum(count)))), np.diff(w.first), count


def join_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words of each row (first: offsets into start and end) joined by one space."""
    size = end - start + 1
    take = ranges(start, size)
    out = raw[np.minimum(take, max(len(raw) - 1, 0))] if len(take) else np.zeros(0, np.uint8)
    stop = np.cumsum(size)
    out[stop - 1] = 0x20
    bounds = np.concatenate(([0], stop))[first]
    last = np.zeros(len(out), bool)
    full = first[1:] > first[:-1]
    last[bounds[1:][full] - 1] = True  # no space after the last word of a row
    lost = np.concatenate(([0], np.cumsum(full)))
    data = out[~last]
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer((bounds - lost).astype(np.int32)), pa.py_buffer(data)])


# --- Given references -----------------------------------------------------------------------------------------------


def _reference(names: list[str | None], texts: list[str]) -> bytes:
    automaton = SuffixAutomaton()
    for t in texts:
        automaton.add(t.encode().split())  # white space of bytes is that of the words
    return pickle.dumps(automaton)


def against_reference(docs: DataFrame, reference: DataFrame, threshold: int = 20, shard_bytes: int = REFERENCE_BYTES, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Documents without the maximal spans of at least threshold words that a text of reference has too.

    docs, reference: doc_id, text. Returns doc_id, n_words, n_removed, kept_text for each row of docs. Shards of
    reference of about shard_bytes (one text at least) become suffix automata on the executors. They are broadcast in
    lots of at most lot_bytes, one after the other; between lots the spans found so far are written to the shared
    folder. So memory is bounded at any size of reference, and the work is docs times the number of lots. Nulls and
    empty texts have no words; empty references remove nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("cast(array() as array<struct<start: int, stop: int>>)").alias("spans"))

    def spans_of(lot: list[bytes]):
        shared = spark.sparkContext.broadcast(lot)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = [pickle.loads(x) for x in shared.value]
            for b in small_batches(batches, "text"):
                w = Words(*text_bytes(b.column(1)))
                edge = np.zeros(len(w) + 1, np.int64)
                for r, old in enumerate(b.column(2).to_pylist()):
                    for x in old:
                        edge[w.first[r] + x["start"]] += 1
                        edge[w.first[r] + x["stop"]] -= 1
                    a, z = int(w.first[r]), int(w.first[r + 1])
                    tokens = [w.bytes_of(j) for j in range(a, z)]
                    for automaton in automata:
                        for j, (n, _) in enumerate(automaton.follow(tokens), a):
                            if n >= threshold:
                                edge[j - n + 1] += 1
                                edge[j + 1] -= 1
                yield b, w, np.cumsum(edge)[:-1] > 0

        return run

    def note(run):
        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, w, gone in run(batches):
                out = []
                for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    at = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:z].astype(np.int8), [0])))).reshape(-1, 2)
                    out.append([{"start": int(x), "stop": int(y)} for x, y in at])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, b.column(2).type)], schema=b.schema)

        return spans

    def cut(run):
        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, w, gone in run(batches):
                texts, words, count = _without(w, ~gone, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(words - count), texts], schema=_OUT)

        return rest

    with scratch(spark) as keep:
        names = reference.select(F.coalesce(F.col("doc_id").cast("string"), F.col("text")).alias("name"), "text")
        made = table(shards(names, max(1, -(-total_bytes(reference) // shard_bytes)), _reference), "reference_automata")
        rest = lots(made, "made", lot_bytes)
        now = next(rest)
        for following in rest:
            df, now = table(df.mapInArrow(tidy(note(spans_of([bytes(r["made"]) for r in now]))), df.schema), "spans"), following
        if hasattr(df, "written_at"):
            keep(df)  # the last pass reads it
        return df.mapInArrow(tidy(cut(spans_of([bytes(r["made"]) for r in now]))), "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
