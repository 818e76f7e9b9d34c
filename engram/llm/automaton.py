"""Generalised suffix automata: built by shards of bounded size on the executors, broadcast in lots of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import ship

#: Bytes of pickled shards that are broadcast at a time; a worker takes about ten times as much for them.
LOT_BYTES = 8 << 20


class SuffixAutomaton:
    """All substrings of some sequences of tokens; built online, one sequence after another.

    A state stands for the substrings that end at the same places, the longest of length[state] tokens; link[state] is
    that of the longest suffix with more ends.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def __len__(self) -> int:
        return len(self.next)

    def add(self, tokens: Sequence[Hashable]) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for t in tokens:
            if t in nxt[last]:
                q = nxt[last][t]
                last = q if length[q] == length[last] + 1 else self._clone(last, t, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and t not in nxt[p]:
                nxt[p][t] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][t]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, t, q)
            last = cur

    def _clone(self, p: int, t: Hashable, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(t) == q:
            nxt[p][t] = c
            p = link[p]
        return c

    def follow(self, tokens: Sequence[Hashable], most: int | None = None) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each position, the length of the longest match that ends there, and its state.

        most: lengths stop there, and the state is that of the match's last so many tokens.
        """
        nxt, link, length = self.next, self.link, self.length
        v, n = 0, 0
        for t in tokens:
            while v and t not in nxt[v]:
                v = link[v]
                n = length[v]
            if t in nxt[v]:
                v = nxt[v][t]
                n += 1
                if most is not None and n >= most:
                    n = most
                    while length[link[v]] >= most:
                        v = link[v]
            else:
                n = 0
            yield n, v

    def matches(self, tokens: Sequence[Hashable]) -> list[int]:
        return [n for n, _ in self.follow(tokens)]

    def spread(self, values: list, join: Callable) -> list:
        """values (by state; None: nothing) joined with those of all states that a state is a suffix of."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if values[v] is not None:
                u = self.link[v]
                values[u] = values[v] if values[u] is None else join(values[u], values[v])
        return values


def shards(texts: DataFrame, n: int, make: Callable[[list[str | None], list[str]], bytes]) -> DataFrame:
    """shard, made: what make builds of the (names, texts) of each of n shards, every shard in a task of its own.

    texts: name (string), text; a null text is empty. Rows are dealt by hash of the name, equal names together.
    """
    ship(texts.sparkSession)

    def build(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("name").to_pylist(), t.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is None, x))
        return pa.table({"shard": t.column("shard").slice(0, 1), "made": pa.array([make([a for a, _ in rows], [b for _, b in rows])], pa.binary())})

    dealt = texts.select("name", F.coalesce("text", F.lit("")).alias("text")).withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(n)))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, made binary")


def lots(made: DataFrame, column: str, most: int) -> Iterator[list]:
    """Rows of a written table in lots of at most so many bytes of a column, one row at least; the driver holds one lot."""
    lot: list = []
    size = 0
    for r in made.toLocalIterator():
        if lot and size + len(r[column]) > most:
            yield lot
            lot, size = [], 0
        lot.append(r)
        size += len(r[column])
    yield lot
