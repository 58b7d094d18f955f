"""Winnowed anchors of a text: positions picked from its content alone."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POS_BITS = 20
_POS_MASK = np.uint64((1 << _POS_BITS) - 1)
#: Longer texts are handled in segments that overlap, which picks the same anchors.
SEGMENT = 1 << 19

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hash of any slice of a text in constant time (polynomial prefix sums modulo 2**64)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.up, self.down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        d = self.sums[k:] - self.sums[:-k]
        return mix(d * self.down[: len(d)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, in two passes over blocks of ``w``."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(text: str, k: int, w: int):
    """``(pos, first, last, hash, hashes, shift)`` arrays per segment of ``text``.

    Each window of ``w`` consecutive k-grams picks its least hash, the rightmost
    at ties; so equal stretches of ``w + k - 1`` characters pick the same place
    wherever they stand. ``first`` and ``last`` are the first and last start of
    the windows (all in between, too) that pick the anchor. Positions are
    relative to the segment, which begins at ``shift``.
    """
    codes = code_points(text)
    span = w + k - 1
    for shift in range(0, max(1, len(codes) - span + 1), SEGMENT):
        part = codes[shift : shift + SEGMENT + span - 1]
        if len(part) < span:
            return
        hashes = Hashes(part)
        grams = hashes.grams(k)
        keyed = (grams & ~_POS_MASK) | (_POS_MASK - np.arange(len(grams), dtype=np.uint64))
        picked = (_POS_MASK - (sliding_min(keyed, w) & _POS_MASK)).astype(np.int64)
        cut = np.flatnonzero(picked[1:] != picked[:-1]) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(picked) - 1]])
        pos = picked[first]
        yield pos, first, last, grams[pos], hashes, shift
