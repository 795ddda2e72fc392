"""Words, word hashes and shingles of many texts at once, in numpy.

Texts come as Arrow string arrays; they are worked on in runs of a few megabytes,
so memory is bounded by the longest single text.  Words are maximal runs of bytes
that are none of space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, where no single text is longer.
RUN_BYTES = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASIS = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _R)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse modulo 2**64."""
    if len(_powers[which]) < n:
        base = int(_R) if which == "up" else pow(int(_R), -1, 1 << 64)
        out = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
        out[0] = 1
        _powers[which] = np.cumprod(out, dtype=np.uint64)
    return _powers[which][:n]


@dataclass
class Run:
    """Words of consecutive texts: rows lo..hi of the batch, in their order."""

    lo: int
    hi: int
    data: np.ndarray  # bytes
    start: np.ndarray  # of words in data
    stop: np.ndarray
    first: np.ndarray  # hi - lo + 1 offsets: words first[i]..first[i + 1] belong to row lo + i
    offsets: np.ndarray  # of the rows in data
    _sums: np.ndarray | None = None

    def hashes(self, stop: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of what they begin with where stop is given."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * _power("up", n), out=self._sums[1:])
        ends = self._sums[self.stop if stop is None else stop]
        return mix((ends - self._sums[self.start]) * _power("down", n + 1)[self.start])

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def no_letter(data: np.ndarray) -> np.ndarray:
    return _NO_LETTER[data]


def _small_latin(data: np.ndarray) -> np.ndarray:
    """Lower-cases the letters of two bytes that begin with 0xC3."""
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][capital] += 32
    return data


def runs(texts: pa.Array, lower: bool, limit: int = RUN_BYTES, letters: bool = False) -> Iterator[Run]:
    """texts: a string array; null counts as empty.  letters: words are runs of letters, and Latin capitals go too."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        data = (_LOWER if lower else _ASIS)[whole[offsets[lo] : offsets[hi]]]
        at = offsets[lo : hi + 1] - offsets[lo]
        if letters and lower:
            data = _small_latin(data)
        yield _split(lo, hi, data, at, _NO_LETTER if letters else _SPACE)
        lo = hi


def _split(lo: int, hi: int, data: np.ndarray, at: np.ndarray, space: np.ndarray) -> Run:
    word = ~space[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = at[:-1] < at[1:]
    heads, tails = at[:-1][full], at[1:][full] - 1  # a text's edge parts words too
    begins[heads] = word[heads]
    ends[tails] = word[tails]
    start = np.flatnonzero(begins)
    return Run(lo, hi, data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at), at)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; the last k - 1 are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for i in range(k):
        out += hashes[i : i + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(out)


def shingle_sets(run: Run, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each row; a shorter text is one shingle, no words none."""
    words = run.hashes()
    every = grams(words, k)
    out = []
    for a, b in zip(run.first[:-1].tolist(), run.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            short = grams(words[a:b], b - a) ^ np.uint64(b - a) if b > a else words[:0]
            out.append(mix(short))
    return out
