"""Words, word hashes and n-gram hashes of many texts at once, in numpy, straight from UTF-8 bytes.

Word separators are ASCII, so bytes suffice: no byte of a longer UTF-8 sequence is below 0x80.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_R, _Q = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_BLOCK = 1 << 18

#: All but white space: `[^\x20\x09-\x0D]`.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


@lru_cache(2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.ones(n, U)
        have = 1
        step = U(b)
        with np.errstate(over="ignore"):
            while have < n:
                more = min(have, n - have)
                out[have : have + more] = out[:more] * step
                have += more
                step = step * step
        return out

    return run(base), run(_inverse(base))


@lru_cache(1)
def _table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240101)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


class Words:
    """start, end: bytes of each word; doc: its row; first: the words' offsets by row (rows + 1)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray = SPACED, lower: bool = False):
        if lower:
            raw = LOWER[raw]
        self.raw, self.offsets = raw, offsets
        n, rows = len(raw), len(offsets) - 1
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            inside = keep[raw]
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            at = offsets[:-1][offsets[:-1] < n]
            begins[at] = inside[at]
            at = offsets[1:][offsets[1:] > 0] - 1
            ends[at] = inside[at]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, equal for equal words wherever they stand; in blocks, so that memory stays bounded."""
        out = np.empty(len(self), U)
        tab = _table()
        power, back = _powers(int(_R), _BLOCK)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(self):
                j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _BLOCK, "right")))
                a, b = self.start[i], self.end[j - 1]
                if b - a > _BLOCK:  # one very long word
                    total, shift = U(0), U(1)
                    for k in range(a, b, _BLOCK):
                        piece = tab[self.raw[k : min(b, k + _BLOCK)]]
                        total = total + (piece * power[: len(piece)]).sum(dtype=U) * shift
                        shift = shift * power[-1] * _R
                    out[i] = total
                else:
                    sums = np.zeros(b - a + 1, U)
                    np.cumsum(tab[self.raw[a:b]] * power[: b - a], out=sums[1:])
                    s = self.start[i:j] - a
                    out[i:j] = (sums[self.end[i:j] - a] - sums[s]) * back[s]
                i = j
            return mix(out + (self.end - self.start).astype(U) * _Q)

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len - k + 1 values; none where there are fewer words)."""
    if len(h) < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        done, width, have = None, 0, h  # have: hash of 2^s words
        size = 1
        rest = k
        while rest:
            if rest & 1:
                if done is None:
                    done, width = have, size
                else:
                    q = U(pow(int(_Q), size, 1 << 64))
                    n = min(len(done), len(have) - width)
                    done = done[:n] * q + have[width : width + n]
                    width += size
            rest >>= 1
            if rest:
                q = U(pow(int(_Q), size, 1 << 64))
                have = have[: len(have) - size] * q + have[size:]
                size *= 2
        return mix(done[: len(h) - k + 1] + U(k) * _R)


def whole(words: Words, k: int) -> np.ndarray:
    """Positions from which k words of one row follow."""
    n = len(words) - k + 1
    return np.flatnonzero(words.doc[:n] == words.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def lowest(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of the k values from each position on."""
    size, have = 1, x
    while size * 2 <= k:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    return have if size == k else np.minimum(have[: len(x) - k + 1], have[k - size : len(x) - size + 1])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)
