"""Longest common subsequences and overlaps of two sequences, in linear space."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: A word at more than this share of the places keeps its bits; others are made when met, so that all bits stay linear.
_FREQUENT = 256


class _Bits:
    """For each word of ``b`` the bits of its places."""

    def __init__(self, b: Sequence[Hashable]):
        self.n, self.places, self.kept = len(b), {}, {}
        for j, w in enumerate(b):
            self.places.setdefault(w, []).append(j)

    def of(self, word: Hashable) -> int:
        at = self.places.get(word)
        if at is None:
            return 0
        if len(at) == 1:
            return 1 << at[0]
        if (bits := self.kept.get(word)) is None:
            mark = np.zeros(self.n, bool)
            mark[at] = True
            bits = int.from_bytes(np.packbits(mark, bitorder="little").tobytes(), "little")
            if len(at) * _FREQUENT > self.n:
                self.kept[word] = bits
        return bits


def common_lengths(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b`` (0 to ``len(b)`` words).

    One row of the usual table at a time, a bit a place: ``len(a) * len(b) / 64`` steps of a machine word.
    """
    bits, full = _Bits(b), (1 << len(b)) - 1
    row = full
    for word in a:
        if hit := row & bits.of(word):
            row = ((row + hit) | (row - hit)) & full
    raw = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(raw, count=len(b), bitorder="little").astype(np.int64))])


def _first_pair(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int] | None:
    """The first pair of places that some longest common subsequence matches: ``a`` is halved, only one half goes on."""
    i = j = 0
    while a and b:
        if len(a) == 1:
            return (i, j + b.index(a[0])) if a[0] in b else None
        mid = len(a) // 2
        before = common_lengths(a[:mid], b)
        both = before + common_lengths(a[mid:][::-1], b[::-1])[::-1]
        cut = int(both.argmax())
        if before[cut]:
            a, b = a[:mid], b[:cut]
        else:
            a, b, i, j = a[mid:], b[cut:], i + mid, j + cut
    return None


def difference(a: list, b: list) -> tuple[int, tuple[int, int] | None]:
    """How many words ``a`` and ``b`` share in order at most, and the places of ``a`` that the first difference covers."""
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    if head == len(a) == len(b):
        return head, None
    tail = 0
    while tail < least - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    p, q = a[head : len(a) - tail], b[head : len(b) - tail]
    shared = int(common_lengths(p, q)[-1]) if p and q else 0
    first = _first_pair(p, q) if shared else None
    return head + shared + tail, (head, head + (first[0] if first else len(p)))


def overlap(own: str, following: str) -> int:
    """Length of the longest end of ``own`` that begins ``following``, by the prefix function (Knuth, Morris, Pratt)."""
    if not own or own[-1] not in following:
        return 0
    own = own[-len(following) :]
    fail, k = [0] * len(following), 0
    for i in range(1, len(following)):
        while k and following[i] != following[k]:
            k = fail[k - 1]
        k += following[i] == following[k]
        fail[i] = k
    k = 0
    for c in own:
        while k and (k == len(following) or following[k] != c):
            k = fail[k - 1]
        k += following[k] == c
    return k
