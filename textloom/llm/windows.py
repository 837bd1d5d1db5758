"""Fixed-length windows over token sequences: fingerprints, anchors and ranges.

Shared by the two exact-repeat operators (windows of words, windows of bytes).
All functions work on one numpy batch: the tokens of several documents laid end
to end, with ``ends`` holding each document's end offset.

*Fingerprint*: a polynomial over 64-bit token hashes modulo 2**64, twice with
independent token hashes, so 128 bits name the content of any stretch.

*Anchor*: of the ``w = window - gram + 1`` grams inside a window, the leftmost
one of smallest hash.  Equal windows have equal anchors at equal offsets, so
anchors are a cover sample whatever the windows' positions are.  Consecutive
windows with one anchor form a *range*; there are about ``2 n / (w + 1)``.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit bijective mixer (xor-shift and multiply)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict = {}


def _powers(n: int, which: int, inverse: bool) -> np.ndarray:
    key = (which, inverse)
    if len(_POWERS.get(key, ())) < n:
        b = pow(_BASE[which], -1, 2**64) if inverse else _BASE[which]
        p = np.full(max(n, 1 << 20), b, dtype=U64)
        p[0] = 1
        _POWERS[key] = np.cumprod(p, dtype=U64)
    return _POWERS[key][:n]


class Fingerprints:
    """Content names of stretches ``[a, a + length)`` of one batch."""

    def __init__(self, hashes: np.ndarray, which: int):
        n = len(hashes)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(hashes * _powers(n, which, False), dtype=U64, out=self.sums[1:])
        self.inverse = _powers(n + 1, which, True)

    def at(self, a: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[a + length] - self.sums[a]) * self.inverse[a])

    def all(self, length: int) -> np.ndarray:
        s = self.sums
        return mix((s[length:] - s[:-length]) * self.inverse[: len(s) - length])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Batch:
    """Windows, ranges and fingerprints of the documents of one batch.

    ``valid``: window starts that lie within their document.  ``start``,
    ``count``, ``anchor`` and ``doc`` describe the ranges: first window, number
    of windows, anchor hash, document's place in the batch.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, window: int, gram: int):
        self.window, self.lengths = window, lengths
        self.begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.first = Fingerprints(hashes, 0)
        self._hashes, self._second = hashes, None
        n = len(hashes)
        if n < window:
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, U64)
            return
        grams = self.first.all(gram)
        low = sliding_min(grams, window - gram + 1)
        ok = np.repeat(self.begin[1:], lengths)[: len(low)] - np.arange(len(low)) >= window
        cut = np.ones(len(low), dtype=bool)  # a range begins here
        cut[1:] = (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1]) | ~ok[:-1]
        cut &= ok
        self.start = np.flatnonzero(cut)
        size = np.concatenate([[0], np.cumsum(ok)])
        self.count = size[np.append(self.start[1:], len(low))] - size[self.start]
        self.anchor = low[self.start]
        self.doc = np.searchsorted(self.begin, self.start, side="right") - 1

    @property
    def second(self) -> Fingerprints:
        if self._second is None:
            self._second = Fingerprints(mix(self._hashes, 7), 1)
        return self._second

    def names(self, a: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of stretches, as two signed 64-bit columns."""
        return self.first.at(a, length).view(np.int64), self.second.at(a, length).view(np.int64)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All members of the ranges ``[start, start + count)``, in order."""
    total = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(start - total[:-1], count) + np.arange(total[-1])


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Mask of the places within ``length`` from any of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + length, n), 1)
    return np.cumsum(edge[:n]) > 0
