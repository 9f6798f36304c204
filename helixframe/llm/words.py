"""Word hashes of whole texts in numpy, and memories that outlive a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

_rng = np.random.default_rng(77)
LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: Words of more bytes are hashed by xxhash: polynomials modulo 2 ** 64 of long words can be made to collide.
LONG = 64


class WordHasher:
    """64-bit hashes of the words (runs without white space) of a text's bytes, in order.

    A word is a polynomial in its bytes modulo 2 ** 64, read off prefix sums
    of the whole text and shifted back to the word's start. With ``cut``,
    words of more bytes than that are cut where two neighbouring bytes say
    so (about every eighth), so an edit changes a piece and not the word.
    """

    def __init__(self, cut: int = 0):
        self.cut = cut
        self._powers(1 << 14)

    def _powers(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(n, BASE, np.uint64)]))
        self.down = np.cumprod(np.concatenate([one, np.full(n, BACK, np.uint64)]))

    def _pieces(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        long = np.flatnonzero(size > self.cut)
        if not len(long):
            return start, end
        n = size[long]
        at = np.repeat(start[long] - np.cumsum(n) + n, n) + np.arange(n.sum())
        first = np.repeat(start[long], n)
        value = b[at].astype(np.uint32) * np.uint32(0x9E3779B1) + b[np.maximum(at - 1, 0)] * np.uint32(0x85EBCA6B)
        at = at[(at > first) & ((value >> np.uint32(13)) % np.uint32(8) == 0)]
        return np.sort(np.concatenate([start, at])), np.sort(np.concatenate([end, at]))

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, where each word starts)."""
        return self.spans(raw)[:2]

    def spans(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, where each word starts, its bytes)."""
        b = np.frombuffer(raw, np.uint8)
        n = len(b)
        if n + 1 > len(self.up):
            self._powers(2 * n)
        full = np.zeros(n + 2, np.int8)
        full[1:-1] = ~BLANK[b]
        edge = np.diff(full)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if self.cut:
            start, end = self._pieces(b, start, end)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTER[b] * self.up[:n], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        h = mix(h + (end - start).astype(np.uint64))
        for k in np.flatnonzero(end - start > LONG):
            h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
        return h, start, end - start


_MEMORY: dict[str, object] = {}


def remembered(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for later tasks of the same worker process."""
    if key not in _MEMORY:
        _MEMORY[key] = make()
    return _MEMORY[key]
