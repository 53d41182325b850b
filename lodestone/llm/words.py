"""Vectorised word hashing over whole batches of texts.

A word is a maximal run of bytes other than space and \\t..\\r, so UTF-8 texts
split exactly as the pattern [^\\x20\\x09-\\x0D]+ does.  Each word gets a
64-bit hash from a prefix polynomial over a random byte table, normalised to
its own start, so equal words hash alike wherever they stand.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240607)
_PLAIN = (_rng.integers(1, 2**63, 256, dtype=np.uint64) << U(1)) | U(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words of letters only: every ASCII byte that is no letter parts words.
NOT_LETTERS = np.arange(256) < 128
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = False
_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = []
_SEGMENT = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        n = max(n, _SEGMENT + 4096)
        _POW[:] = [np.cumprod(np.concatenate(([U(1)], np.full(n, U(b))))) for b in (_BASE, _INVERSE)]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0x9FB21C651E98DF25)
    return h ^ (h >> U(32))


class Words:
    """All words of a batch: hash, start and end (in `data`), and per text the range offset[i]:offset[i+1]."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, space: np.ndarray = _SPACE):
        self.data = b"\n".join(t or b"" for t in texts) + b"\n"
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        hashes, starts, ends = [], [], []
        at, n = 0, len(self.data)
        while at < n:
            to = min(n, at + _SEGMENT)
            if to < n:
                cut = max(self.data.rfind(s, at, to) for s in (b" ", b"\n"))
                if cut <= at:  # a word longer than the segment
                    nxt = [x for s in (b" ", b"\n") if (x := self.data.find(s, to)) >= 0]
                    cut = min(nxt) if nxt else n - 1
                to = cut + 1
            h, s, e = self._segment(np.frombuffer(self.data, np.uint8, to - at, at), _LOWER if lower else _PLAIN, space)
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            at = to
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, U)
        self.start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        self.offset = np.searchsorted(self.start, begins)
        self.count = np.diff(self.offset)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    @staticmethod
    def _segment(b: np.ndarray, codes: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.diff(np.concatenate(([True], space[b], [True])).view(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _powers(len(b) + 1)
        total = np.concatenate(([U(0)], np.cumsum(codes[b] * power[: len(b)])))
        return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U)), s, e

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, bool)
        a = self.hash[:n].copy()
        for j in range(1, k):
            a *= U(0x9E3779B97F4A7C15)
            a ^= a >> U(31)
            a += self.hash[j : j + n]
        return mix(a), self.doc[:n] == self.doc[k - 1 :]
