"""Operator 9: token ids in segments, with document boundaries and document ids in Elias-Fano form.

A segment: 8 bytes "EGSEG002"; then int64: documents n, of these without an id, the least id, id size in bytes, bytes of
each part; then the parts: ids of documents as Elias-Fano of what is added to the least, their ends as Elias-Fano, the
token ids, little-endian. An Elias-Fano part: int64 n, low bits l, bytes of lower and upper; the low l bits of each
value, packed; the high parts in unary, where bit high(i) + i is set; as 32-bit numbers the position of every 64th set
bit. Values ascend, so n of them up to u take about n * (2 + log2(u / n)) bits, and select reads one without the others.
Segments are rows of a table, so Spark commits them and any store that Spark writes will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import about_bytes, documents, ship, small_batches, table, text_bytes
from engram.llm.tokens import unusual_space, word_tokens

MAGIC = b"EGSEG002"
SEGMENT_BYTES = 2 << 20
PART_BYTES = 16 << 20
_STEP = 64
#: By how much ids of documents differ in a segment at most.
MOST_APART = 1 << 62
SEGMENTS = "part int, seq int, n_docs long, n_ids long, payload binary"


class EliasFano:
    """Ascending numbers from 0 on; get(i) takes a few steps, whatever their number."""

    def __init__(self, data: bytes):
        self.n, self.low, lower, upper = map(int, np.frombuffer(data, "<i8", 4))
        self.lower = data[32 : 32 + lower]
        self.upper = data[32 + lower : 32 + lower + upper]
        self.marks = np.frombuffer(data, "<u4", -(-self.n // _STEP), 32 + lower + upper)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n, u = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (u // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
        upper = np.zeros(n + (u >> low) + 1, np.uint8)
        at = (values >> low) + np.arange(n)
        upper[at] = 1
        lower, high = (np.packbits(x, bitorder="little").tobytes() for x in (bits, upper))
        return b"".join([np.array([n, low, len(lower), len(high)], "<i8").tobytes(), lower, high, at[::_STEP].astype("<u4").tobytes()])

    def _select(self, i: int) -> int:
        """The position of the i-th set bit: from the mark before it on, word by word, then bit by bit."""
        at, rest = int(self.marks[i // _STEP]), i % _STEP
        byte = at // 8
        word = int.from_bytes(self.upper[byte : byte + 8], "little") >> at % 8 << at % 8
        while (count := word.bit_count()) <= rest:
            rest -= count
            byte += 8
            word = int.from_bytes(self.upper[byte : byte + 8], "little")
        for _ in range(rest):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def get(self, i: int) -> int:
        first = i * self.low
        bits = int.from_bytes(self.lower[first // 8 : (first + self.low + 7) // 8], "little") >> first % 8
        return ((self._select(i) - i) << self.low) | bits & ((1 << self.low) - 1)


def encode_segment(doc_ids: list[int | None], ids: list[bytes], kind: str) -> bytes:
    """Packs documents, each with its packed ids, into a segment. doc_ids ascend, null ones first."""
    width = np.dtype(kind).itemsize
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    named = [x for x in doc_ids if x is not None]
    least = named[0] if named else 0
    wide = named[-1] - least if named else 0
    if wide > MOST_APART:
        raise ValueError("ids of one segment are too far apart")
    parts = [EliasFano.encode(np.array([x - least for x in named], np.int64)), EliasFano.encode(ends), b"".join(ids)]
    head = np.array([len(ids), len(ids) - len(named), least, width, *map(len, parts)], "<i8").tobytes()
    return b"".join([MAGIC, head, *parts])


class Segment:
    """Reads a segment."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a segment")
        head = np.frombuffer(payload, "<i8", 7, 8)
        self.n, self.nulls, self.least, width = map(int, head[:4])
        cut = 64 + np.concatenate(([0], np.cumsum(head[4:])))
        part = [payload[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.named, self.bounds = EliasFano(part[0]), EliasFano(part[1])
        self.ids = np.frombuffer(part[2], f"<u{width}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.named.get(i - self.nulls)

    def end(self, i: int) -> int:
        """Ids of documents 0 to i together."""
        return self.bounds.get(i) if i >= 0 else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.end(i - 1) : self.end(i)]


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 1, segment_bytes: int = SEGMENT_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Token ids of docs (doc_id, text) as a table of segments in ascending order of (part, seq), written and reread.

    A null text is empty and yields the end id alone; null ids come first; rows that share an id stand together,
    in an order by hash of the text and text. tokenizer: a file of the tokenizers library that drops white space, see WordTokens; executors read it at
    this path. Documents are range-dealt by id before they are encoded: text takes less space than its ids.
    """
    spark = docs.sparkSession
    ship(spark)
    n = max(2 * spark.sparkContext.defaultParallelism, -(-about_bytes(docs) // part_bytes), 1)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # many rows of one id, or none, may part at a text
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        close = np.array([end_id], coder.kind).tobytes()
        keys: list[int | None] = []
        ids: list[bytes] = []
        size, least = 0, None

        def segment() -> pa.RecordBatch:
            width = len(close)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(keys), "n_ids": sum(map(len, ids)) // width, "payload": encode_segment(keys, ids, coder.kind)}], fields)

        for b in small_batches(batches, "text"):
            odd = unusual_space(*text_bytes(b.column(1))).tolist()
            for key, text, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), odd, strict=True):
                if key is not None and least is not None and key - least > MOST_APART:
                    yield segment()
                    keys, ids, size, seq, least = [], [], 0, seq + 1, None
                keys.append(key)
                least = key if least is None else least
                ids.append(coder.ids(text, o) + close)
                size += len(ids[-1])
                if size >= segment_bytes:
                    yield segment()
                    keys, ids, size, seq, least = [], [], 0, seq + 1, None
        if keys:
            yield segment()

    return table(rows.mapInArrow(run, SEGMENTS), "segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as 32-bit), from a table of segments."""
    ship(segments.sparkSession)
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, payload in zip(*(b.column(i) for i in range(3)), strict=True):
                s = Segment(payload.as_py())
                ends = np.array([s.end(i) for i in range(s.n)], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:z].tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * s.n, pa.int32()), pa.array([seq.as_py()] * s.n, pa.int32()), pa.array([s.doc_id(i) for i in range(s.n)], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], schema=fields)

    within = segments.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("before_seq"))
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as partitions were written
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("before_seq") + F.col("before_part")).alias("before"))
    rows = segments.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_segments(write_segments(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
