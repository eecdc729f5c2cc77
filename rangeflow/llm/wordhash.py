"""Vectorised words and word-window hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch at once; a word class is
a table of 256 flags saying which bytes separate words (both classes in use
are decided by ASCII bytes alone, so bytes of 0x80 and above never separate).
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Words are runs outside \\x20 and \\x09-\\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Odd numbers for the rounds and joins below.
ROUNDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Bytes that a word may have to be its own name; longer ones are named by a keyed digest.
SHORT_WORD = 15
DIGEST_KEY = b"rangeflow words"
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Bytes of text that one vectorised step holds.
STEP_BYTES = 1 << 20


def trim() -> None:
    """Give freed memory back at the end of a task: workers stay, and wait beside busy ones."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        library = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0x9FB21C651E98DF25)
    h ^= h >> U64(32)
    return h


def slices(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes each; a longer single row stands alone."""
    n = len(column)
    if not n:
        return
    _, offsets = buffers(column)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: byte ranges, and which rows they are in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~separators[data]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        inner = offsets[:-1]
        before[inner[inner < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        #: Row i has the words first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def names(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the words, as two halves.

        A word of up to 15 bytes is a number (its bytes and their count) that a bijection
        spreads, so two of them never share a name. Longer ones have a keyed BLAKE2b digest.
        """
        n = len(self.data)
        lens = self.ends - self.starts
        padded = np.zeros(n + 16, np.uint8)
        padded[:n] = LOWER[self.data] if lower else self.data
        eight = np.ndarray((n + 9,), "<u8", padded, strides=(1,))
        x = eight[self.starts] & _LOW_BYTES[np.minimum(lens, 8)]
        y = eight[self.starts + 8] & _LOW_BYTES[np.clip(lens - 8, 0, 7)] | np.minimum(lens, 16).astype(U64) << U64(56)
        for key in ROUNDS:
            x, y = y, x ^ mix(y ^ key)
        for i in np.flatnonzero(lens > SHORT_WORD):
            word = padded[self.starts[i] : self.ends[i]]
            x[i], y[i] = np.frombuffer(hashlib.blake2b(word, digest_size=16, key=DIGEST_KEY).digest(), "<u8")
        return x, y

    def window_starts(self, k: int) -> np.ndarray:
        """Whether a window of k words of one row starts at each word."""
        end = np.repeat(self.first[1:], self.counts)
        return np.arange(len(end)) + k <= end


def _joined(a: tuple, b: tuple) -> tuple:
    """Names of runs of words from the names of their two parts.

    The halves go through a mixing step each time, so that no pattern of
    repeated words cancels out (as it does in polynomials modulo 2^64).
    """
    x = [mix(u * key + v) for u, v, key in zip(a, b, ROUNDS[1:], strict=False)]
    if len(x) == 2:
        x[0] ^= mix(x[1] + ROUNDS[0])
        x[1] ^= mix(x[0] + ROUNDS[3])
    return tuple(x)


def window_names(parts: tuple, k: int) -> tuple:
    """Names of the k words from each position on (shorter by k - 1 than the input).

    ``parts`` are halves of the words' names, one or both. Windows double in
    length, so that k words take about 2 log k passes.
    """
    n = len(parts[0]) - k + 1
    if n <= 0:
        return tuple(np.zeros(0, U64) for _ in parts)
    out, done, piece, size = None, 0, parts, 1
    while True:
        if k & size:
            part = tuple(x[done : done + n] for x in piece)
            out = part if out is None else _joined(out, part)
            done += size
        if done == k:
            return out
        piece = _joined(tuple(x[:-size] for x in piece), tuple(x[size:] for x in piece))
        size *= 2


def covered(flags: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a flagged window of k words."""
    total = np.concatenate(([0], np.cumsum(flags)))
    at = np.arange(1, len(total))
    return total[at] > total[np.maximum(at - k, 0)]
