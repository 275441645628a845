"""Vectorised word spans and 64-bit span hashes over Arrow text columns.

A text column is processed in chunks of half a MB: all texts of a chunk lie in one byte buffer, each followed by a
newline, and every step is one numpy pass over that buffer. A single text longer than a chunk is a chunk of its own,
so texts are always whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_tables: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes of words between ASCII white space (0x20 and 0x09 to 0x0D).
NOT_SPACE = ~byte_set(b" \t\n\x0b\x0c\r")
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = byte_set(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
#: ASCII letters, and every byte of a character beyond ASCII.
LETTER = byte_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection, so that distinct values stay distinct."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 16))
        for k, base in enumerate((_P, _INV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[k] = np.cumprod(t, dtype=np.uint64)
    return _tables[0], _tables[1]


class Chunk:
    """Some whole texts in one buffer: ``data`` (uint8), and where each text starts and ends in it."""

    def __init__(self, lo: int, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.lo, self.data, self.start, self.end = lo, data, start, end
        self.n = len(start)
        self._prefix = None

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where ``mask`` holds. The newline after each text must not be in it."""
        m = np.empty(len(mask) + 2, np.int8)
        m[0] = m[-1] = 0
        m[1:-1] = mask
        d = np.diff(m)
        return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

    def offsets(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` sorted: text k has those from offsets[k] to offsets[k + 1]."""
        return np.append(np.searchsorted(starts, self.start), len(starts))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each text."""
        c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return c[self.end] - c[self.start]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        power, inverse = _powers(len(self.data))
        if self._prefix is None:
            p = np.empty(len(self.data) + 1, np.uint64)
            p[0] = 0
            np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=p[1:])
            self._prefix = p
        h = (self._prefix[ends] - self._prefix[starts]) * inverse[starts]
        return mix(h)

    def folded(self) -> Chunk:
        """The same texts with A-Z lower-cased."""
        return Chunk(self.lo, LOWER[self.data], self.start, self.end)


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and what they have freed would count until they end."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.cumsum(np.concatenate([[0], pc.binary_length(column).to_numpy(zero_copy_only=False) + 1]))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1)
        part = pc.binary_join_element_wise(column.slice(lo, hi - lo), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        yield Chunk(lo, data, at[:-1], at[1:] - 1)
        lo = hi


def windows(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive word hashes of one text, and the index of each run's first word."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out += h[k : len(h) - n + 1 + k]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(h))
    first = np.flatnonzero(left[: len(out)] >= n)
    return mix(out[first]), first
