"""Words and hashes of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words: space and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of letters, digits and everything outside ASCII.
ALNUM = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of an odd base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, U64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=U64))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Texts:
    """Some rows' texts: `data`, their bytes one after another, and `at`, where each row starts, with the end added."""

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray) -> None:
        self.first, self.data, self.at = first, data, at
        self.rows = len(at) - 1

    def lowered(self) -> Texts:
        """The same with A-Z in lower case."""
        d = self.data
        return Texts(self.first, d + (((d >= 65) & (d <= 90)).view(np.uint8) << 5), self.at)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each run of bytes that `is_word` marks; runs end with their row."""
        m = is_word[self.data]
        some = self.at[:-1] < self.at[1:]
        heads, tails = self.at[:-1][some], self.at[1:][some] - 1
        s, e = m.copy(), m.copy()
        s[1:] &= ~m[:-1]
        e[:-1] &= ~m[1:]
        s[heads], e[tails] = m[heads], m[tails]
        starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        return starts, ends, np.searchsorted(self.at, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def texts(column: pa.Array, size: int = 400_000) -> Iterator[Texts]:
    """The rows of a string column in lots of about `size` bytes; null is an empty text. A lot has one row at least."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield Texts(first, data[at[first] : at[stop]], at[first : stop + 1] - at[first])
        first = stop


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every `k` words in a row, by the place of the first; those that would pass their row's end are left out."""
    if len(words) < k:
        return np.zeros(0, U64), np.zeros(0, rows.dtype)
    n = len(words) - k + 1
    h = np.zeros(n, U64)
    for i in range(k):
        h = mix(h * U64(0xA0761D6478BD642F) + words[i : n + i])
    same = rows[:n] == rows[k - 1 :]
    return h[same], rows[:n][same]
