"""Words and shingles of whole batches of texts as numpy arrays.

Words are the runs of bytes outside ``0x20, 0x09-0x0D`` after lower-casing
A-Z.  A word's hash is a polynomial over its bytes, taken as a difference of
prefix sums, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; bounds the working arrays (about 60 bytes a byte).
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Tables for :meth:`split`; one object per task."""

    def __init__(self) -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, 9, 10, 11, 12, 13]] = True
        with np.errstate(over="ignore"):
            self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
            self._grow(CHUNK)

    def _grow(self, n: int) -> None:
        steps = np.full((2, n + 1), [[_P], [_P_INV]], dtype=np.uint64)
        steps[:, 0] = 1
        self.pow, self.inv = np.cumprod(steps, axis=1, dtype=np.uint64)

    def split(self, texts: pa.Array, begins: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
        """(row of each word, hash of each word), in text order.  For each of
        ``begins`` one more array: the hash of a word's first so many bytes,
        0 for words that aren't longer."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
        found, at, end = [], int(off[0]), int(off[-1])
        while at < end:
            to = min(end, at + CHUNK)
            if to < end:
                to = self._cut(data, off, at, to, end)
            found.append(self._chunk(data[at:to], off, at, begins))
            at = to
        if not found:
            return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (1 + len(begins))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _cut(self, data, off, at, to, end) -> int:
        """A place near ``to`` where no word is cut."""
        i = int(off[np.searchsorted(off, to, "right") - 1])
        if i > at:
            return i
        back = np.flatnonzero(self.space[data[at:to]])
        if len(back):
            return at + int(back[-1]) + 1
        while to < end:                      # one word longer than a chunk
            hit = np.flatnonzero(self.space[data[to:to + CHUNK]])
            stop = int(off[np.searchsorted(off, to, "left")])
            if len(hit):
                return min(to + int(hit[0]) + 1, stop)
            if stop <= to + CHUNK:
                return stop
            to = min(end, to + CHUNK)
        return end

    def _chunk(self, b: np.ndarray, off: np.ndarray, at: int, begins: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        n = len(b)
        if n + 1 > len(self.pow):
            self._grow(n)
        word = ~self.space[b]
        first = np.zeros(n + 1, dtype=bool)              # a text begins here
        lo, hi = np.searchsorted(off, at, "left"), np.searchsorted(off, at + n, "right")
        first[off[lo:hi] - at] = True
        first[0] = first[n] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        starts = np.flatnonzero(word & (~before | first[:-1]))
        ends = np.flatnonzero(word & (~after | first[1:])) + 1
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[self.lower[b]] * self.pow[:n], dtype=np.uint64)])
            unit = self.inv[starts]
            h = mix((total[ends] - total[starts]) * unit + (ends - starts).astype(np.uint64))
            first = [np.where(ends - starts > k, mix((total[np.minimum(starts + k, n)] - total[starts]) * unit + np.uint64(k << 32)),
                              np.uint64(0)) for k in begins]
        return np.searchsorted(off, starts + at, "right") - 1, h, *first


def shingles(row: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words; a text with 1 to k-1 words has
    its whole sequence as its only one."""
    if not len(row):
        return row, word
    step = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        full = np.flatnonzero(row[:len(row) - k + 1] == row[k - 1:]) if len(row) >= k else np.zeros(0, np.int64)
        h = np.full(len(full), k, dtype=np.uint64)
        for j in range(k):
            h = h * step + word[full + j]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        count = np.diff(np.concatenate([begin, [len(row)]]))
        short = begin[count < k]
        size = count[count < k]
        s = size.astype(np.uint64)
        for j in range(k - 1):
            has = size > j
            s[has] = s[has] * step + word[short[has] + j]
        r = np.concatenate([row[full], row[short]])
        h = mix(np.concatenate([h, s]))
    return r, h


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then hash."""
    if not len(row):
        return row, h
    o = np.argsort(h)
    o = o[np.argsort(row[o], kind="stable")]
    row, h = row[o], h[o]
    keep = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
    return row[keep], h[keep]
