"""Exact token ids and counts by the tokenizers library, with units of text remembered.

Neither tokenizer joins text across a lone space or line end, so a text's tokens are those of its units one after the
other. Units are kept in a table of bounded bytes in each worker. Plain words, and the run of signs that may follow one,
go to the library's model directly, past its normaliser and pre-tokeniser, which leave them as they are but for case and
the byte alphabet; all else goes through the whole library, and so do texts that hold unusual white space.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters and a run of signs; no apostrophe (contractions are pieces) and no < (special tokens begin with it).
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?*%$#&@|/+=~^_)\\]}}\"-]*)")
#: Units that are kept have no more letters.
_LONGEST = 48


def file_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@lru_cache(1)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_alphabet() -> dict[int, str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


_ALPHABET = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})


def _shown(piece: str) -> str:
    """A piece without control characters in the letters that the model has for its bytes."""
    return piece if piece.isascii() and " " not in piece else piece.encode().decode("latin-1").translate(_ALPHABET)


_ODD = np.zeros(256, bool)
_ODD[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def unusual_space(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space beyond space, tab and line ends."""
    at = np.flatnonzero(_ODD[raw])
    if len(at):
        a = raw[at]
        b, c = (raw[np.minimum(at + k, len(raw) - 1)] for k in (1, 2))
        at = at[
            (a < 0x20)
            | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
            | ((a == 0xE1) & (b >= 0x9A) & (b <= 0xA0))
            | ((a == 0xE2) & (b <= 0x81) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)) | (b == 0x81)))
            | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        ]
    return np.diff(np.searchsorted(at, offsets)) > 0


class _Units(dict):
    """What is known of units of text, in two generations: when one is full, the one before it is forgotten.

    An entry takes about 160 bytes, so most entries in two generations are some 80 MB.
    """

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, unit: str):
        out = self.before.get(unit)
        if out is None:
            out = self.make(unit)
        if len(unit) > _LONGEST:
            return out
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[unit] = out
        return out


class WordTokens:
    """Ids of a tokenizer that lower-cases, drops white space and splits letters, digits and signs."""

    def __init__(self, path: str):
        self.lib = load(path)
        self.code, self.kind = ("H", "=u2") if self.lib.get_vocab_size() < 1 << 16 else ("I", "=u4")
        self.tokenize = self.lib.model.tokenize
        self.signs = _Units(self._piece, 5000)
        self.units = _Units(self._unit)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.tokenize(_shown(piece))])

    def _unit(self, unit: str) -> bytes:
        if m := _PLAIN.fullmatch(unit):
            word, signs = m.groups()
            low = word.lower()
            if signs:
                return self.units[low] + self.signs[signs]
            return self._piece(unit) if low == unit else self.units[low]
        return self._pack(self.lib.encode(unit, add_special_tokens=False).ids)

    def ids(self, text: str, odd: bool) -> bytes:
        """Packed ids of a whole text. odd: it holds unusual white space."""
        if odd:
            return self._pack(self.lib.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.units.__getitem__, text.split()))


_TIGHT = re.compile(r"(?:^|\s) | (?:\s|$)")


class ByteTokens:
    """Numbers of ids of a byte-level tokenizer whose pieces may begin with one space."""

    def __init__(self, path: str):
        self.lib = load(path)
        self.tokenize = self.lib.model.tokenize
        self.signs = _Units(lambda signs: len(self.tokenize(_shown(signs))), 5000)
        self.inner = _Units(self._after_space)

    def _after_space(self, unit: str) -> int:
        if m := _PLAIN.fullmatch(unit):
            word, signs = m.groups()
            return self.inner[word] + self.signs[signs] if signs else len(self.tokenize(_shown(" " + word)))
        return len(self.lib.encode(" " + unit, add_special_tokens=False))

    def count(self, text: str, odd: bool) -> int:
        if odd or _TIGHT.search(text):
            return len(self.lib.encode(text, add_special_tokens=False))
        if not text:
            return 0
        first, *rest = text.split(" ")
        return len(self.lib.encode(first, add_special_tokens=False)) + sum(map(self.inner.__getitem__, rest))


@lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


@lru_cache(1)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)
