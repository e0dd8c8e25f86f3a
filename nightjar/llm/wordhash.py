"""Word boundaries and 64-bit word hashes of a whole Arrow batch of texts.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D.  All six
separators are ASCII, so UTF-8 bytes can be cut without decoding, and every
step below is one numpy pass over the batch's text buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93 | 1)
_GRAM2 = np.uint64(0xA0761D6478BD642F | 1)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(int(base), done, 1 << 64))
        done += step
    return out[:n]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``_powers`` with the longest table so far kept for the worker."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = _POWERS[int(base)] = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``start``/``end`` byte offsets into ``raw``, 64-bit
    ``hash`` of each, and ``first`` (row i owns words first[i]:first[i+1])."""

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = SEPARATORS):
        raw, offsets = text_buffer(column)
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        inside = ~separators[raw]
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            # a word never crosses from one text into the next
            edge = offsets[1:-1][offsets[1:-1] < n]
            begins[edge] = inside[edge]
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        if n:
            ends[:-1] &= ~inside[1:]
            last = offsets[1:-1] - 1
            last = last[last >= 0]
            ends[last] = inside[last]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        low = LOWER[raw] if lower else raw
        # polynomial hash of each word from one running sum over the batch
        self.inv = powers(_inverse(_BASE), n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.total[1:])
        self.hash = self.piece(self.start, self.end)

    def piece(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of any byte ranges, such as word prefixes."""
        h = (self.total[end] - self.total[start]) * self.inv[start]
        return mix(h + (end - start).astype(np.uint64) * _GRAM)

    def __len__(self) -> int:
        return len(self.start)

    def count(self) -> np.ndarray:
        return np.diff(self.first)


class Grams:
    """Hashes of word runs of any length over a batch's word hashes."""

    def __init__(self, hashes: np.ndarray, second: bool = False):
        base = _GRAM2 if second else _GRAM
        n = len(hashes)
        self.inv = powers(_inverse(base), n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        seed = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if second else hashes
        np.cumsum(seed * powers(base, n), out=self.total[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of words start .. start+length-1 (scalar or array length)."""
        return mix((self.total[start + length] - self.total[start]) * self.inv[start])
