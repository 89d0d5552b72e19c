"""Hashes of the words of many texts at once, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once: small enough for the caches, and the memory is bounded.
CHUNK = 400_000
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.multiply.accumulate(np.full(max(n - 1, 0), base, np.uint64))][:n]


class WordHasher:
    """64-bit hashes of words: a polynomial over a table of random bytes' values, mixed; A-Z count as a-z."""

    def __init__(self):
        self.table = mixed(np.arange(1, 257, dtype=np.uint64))[LOWER]
        self.grow(CHUNK)

    def grow(self, n: int) -> None:
        self.up, self.down = powers(BASE, n + 1), powers(pow(BASE, -1, 1 << 64), n + 1)

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and begin of each word of data."""
        t = np.frombuffer(data, np.uint8)
        n = len(t)
        if n >= len(self.up):
            self.grow(n)
        blank = BLANK[t]
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
        begin, end = edge[::2], edge[1::2]
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[t] * self.down[:n], out=run[1:])
        return mixed((run[end] - run[begin]) * self.up[begin] + (end - begin).astype(np.uint64)), begin

    def texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The hashes of the words of each text, in order."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                size += len(texts[j]) + 1
                j += 1
            h, begin = self.hashes(b"\n".join(texts[i:j]))
            cuts = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in texts[i:j])]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield h[a:b]
            i = j
