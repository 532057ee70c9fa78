"""Words of many texts at once: places and 64-bit hashes by numpy over the bytes of a batch.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. A word's hash is a polynomial over
random byte values, finished by a bijective mixer; equal words have equal hashes in every worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[_SPACE] = 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i under 2**bits."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, np.uint64(b), np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(16, int(n).bit_length()), int(base))


def groups(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about `most` bytes together; a longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words of some texts: `hash`, byte places `start` and `stop` in `buf`, and `first`, where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n".join(texts)
        raw = np.frombuffer(self.buf, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
        space = np.concatenate([[True], _SPACE[raw], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.stop = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.text_at)
        if len(self.start):
            up, down = powers(len(raw))
            sums = np.add.reduceat(_BYTES[raw] * up[: len(raw)], self.start)
            self.hash = mix64(sums * down[self.start] + (self.stop - self.start).astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbours: one for every place it can start at, texts not minded."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(hashes))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return mix64((sums[width:] - sums[:-width]) * down[:n] + np.uint64(width))
