"""Vectorised 64-bit hashes of byte ranges (wrap-around polynomials, then mixed)."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(7)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(n: int, base: int, inverse: bool) -> np.ndarray:
    """1, base, base**2 ... (or of its inverse) modulo 2**64; kept for the next call."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), pow(_BASES[base], -1, 2**64) if inverse else _BASES[base], np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Ranges:
    """Hashes of any ranges of one buffer after a single pass over it."""

    def __init__(self, data: np.ndarray, base: int = 0):
        n = len(data)
        self.back = _power(n + 1, base, True)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power(n, base, False), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))
