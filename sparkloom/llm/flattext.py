"""Whole Arrow columns of text as flat arrays: words, their places and their hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE, SPAN_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 64), U)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.concatenate(([U(1)], np.full(len(out) - 1, base, U))), out=out)
        _POWERS[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.copy()
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def pieces(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``size`` bytes: (first row, end row, bytes, row offsets)."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


class Words:
    """The words (runs of bytes other than ASCII white space) of some rows of text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.rows = raw, len(offsets) - 1
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        inside = ~space
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        self.inside = inside
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        #: word_at[r] to word_at[r + 1] are the words of row r
        self.word_at = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, U)
        length = self.end - self.start
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        terms = (self.raw[self.inside].astype(U) + U(1)) * powers(BYTE_BASE, int(length.max()))[place]
        return mix(np.add.reduceat(terms, first) + length.astype(U))

    def text(self, word: int) -> bytes:
        return self.raw[self.start[word] : self.end[word]].tobytes()


def rolling(h: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of all runs of ``n`` entries of ``h`` (one fewer than n shorter than h), across row borders."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for k, p in enumerate(powers(base, n)):
        out += h[k : k + len(out)] * p
    return mix(out)


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of ``n`` entries."""
    if len(h) < n:
        return h[:0]
    span, low = 1, h
    while span * 2 <= n:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = n - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
