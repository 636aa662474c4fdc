"""Words and their 64-bit hashes for whole Arrow batches, in numpy.

A word is a maximal run of bytes outside space and 0x09-0x0D; these are ASCII, so cutting UTF-8
bytes gives the same words as cutting code points. A word's hash is a polynomial over its bytes,
read from one running sum over the batch, then mixed; two different words share a hash with a
chance of about 2**-64 on text that was not made to defeat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import worker

BATCH_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Also turns ASCII punctuation into spaces, so that "word," and "word" are one word.
_PLAIN = _FOLD.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum() and not 9 <= b <= 13]] = 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept in the worker."""
    kept = worker.store("words")
    if "powers" not in kept or len(kept["powers"][0]) < n:
        n = max(n, BATCH_BYTES + 1024)
        tables = []
        with np.errstate(over="ignore"):
            for base in (_BASE, _INVERSE):
                t = np.full(n, base, np.uint64)
                t[0] = 1
                tables.append(np.cumprod(t))
        kept["powers"] = tables
    return kept["powers"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """The words of some consecutive texts. ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray  # bytes of all texts, one newline after each
    at: np.ndarray  # start of each text in data, and the end
    start: np.ndarray  # byte positions of words
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray  # running polynomial, sums[k] covers data[:k]

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * _power_tables(len(self.sums))[1][start])

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside one text, and the text of each."""
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        text = self.text_of_word()
        inside = text[:m] == text[n - 1 :]
        with np.errstate(over="ignore"):
            acc = np.zeros(m, np.uint64)
            for i in range(n):
                acc = acc * np.uint64(_BASE) + h[i : i + m]
        return mix(acc)[inside], text[:m][inside]


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array, nulls as empty texts."""
    pa.default_memory_pool().release_unused()  # of the batches before
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def runs(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together; a longer text is a run of its own."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def words(texts: pa.Array, lo: int, hi: int, fold_case: bool, plain: bool = False) -> Words:
    """Words of texts[lo:hi]; ``fold_case`` lower-cases A-Z only, ``plain`` drops ASCII punctuation as well."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + lo : texts.offset + hi + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0] + np.arange(hi - lo + 1)
    data = np.full(len(raw) + hi - lo, 10, np.uint8)
    gaps = np.ones(len(data), bool)
    gaps[at[1:] - 1] = False
    data[gaps] = _PLAIN[raw] if plain else _FOLD[raw] if fold_case else raw
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        terms = _BYTE[data]
        terms *= _power_tables(len(data) + 1)[0][: len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
    return Words(data, at, start, end, np.searchsorted(start, at), sums)
