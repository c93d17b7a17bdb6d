"""Vectorised word boundaries and substring hashes over many texts in one byte buffer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_R = 0x9E3779B97F4A7C15 | 1
_INV = pow(_R, -1, 1 << 64)


@lru_cache(1)
def _letters() -> np.ndarray:
    """A fixed pseudo-random number for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Buffer:
    """Texts (bytes) laid end to end, each followed by a line break; words are runs of anything but ASCII white space.

    start, end: of each word; owner: the number of its text. hash(a, z): 64-bit digests of the bytes from a to z."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
        self.n = len(texts)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))  # every text ends in a space
        self.start, self.end = edge[::2], edge[1::2]
        self.space = space
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.text_start = np.concatenate([[0], ends[:-1]]).astype(np.int64) if texts else ends
        self.owner = np.searchsorted(ends, self.start, side="right")
        self._sums = None

    def hash(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        size = 1 << max(10, int(len(self.bytes)).bit_length())
        with np.errstate(over="ignore"):
            if self._sums is None:
                terms = _letters()[self.bytes] * _powers(size, _R)[: len(self.bytes)]
                self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            h = (self._sums[z] - self._sums[a]) * _powers(size, _INV)[a]
            return mix64(h ^ (z - a).astype(np.uint64))


def chunks(texts: list, size: int = 1 << 20):
    """Runs of positions whose texts together have about `size` bytes or more, whole texts only."""
    at, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= size:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
