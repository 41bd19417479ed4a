"""Vectorised 64-bit hashes: a mixer and hashes of any byte range of a buffer."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0xD1342543DE82EF95)
_BASE_INVERSE = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_POWERS = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << n.bit_length())
        steps = np.full(size, base, _U)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= 1 << 22:  # longer tables serve one long text only
            _POWERS[base] = have
    return have[:n]


class RangeHash:
    """Hashes of ranges of one buffer of bytes, or of 64-bit values; equal ranges hash alike wherever they start."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum((_TABLE[buffer] if buffer.dtype == np.uint8 else buffer) * _powers(_BASE, n), out=self.sums[1:])
        self.unshift = _powers(_BASE_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.unshift[start]
        return mix(raw + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


_NARROW = np.uint32
_NARROW_BASE = _NARROW(0x9E3779B1)
_NARROW_INVERSE = _NARROW(pow(0x9E3779B1, -1, 1 << 32))
_NARROW_TABLE = (_TABLE >> _U(32)).astype(_NARROW)
_NARROW_POWERS: dict = {}


def _narrow_powers(base: np.uint32, n: int) -> np.ndarray:
    have = _NARROW_POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(1 << 20, 1 << n.bit_length()), base, _NARROW)
        steps[0] = 1
        have = np.cumprod(steps, dtype=_NARROW)
        if len(have) <= 1 << 22:
            _NARROW_POWERS[base] = have
    return have[:n]


def narrow_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32-bit hashes of byte ranges, at half the cost of RangeHash: enough to tell the words of a passage apart."""
    sums = np.zeros(len(buffer) + 1, _NARROW)
    np.cumsum(_NARROW_TABLE[buffer] * _narrow_powers(_NARROW_BASE, len(buffer)), out=sums[1:])
    x = (sums[end] - sums[start]) * _narrow_powers(_NARROW_INVERSE, len(buffer) + 1)[start]
    x ^= x >> _NARROW(15)
    x *= _NARROW(0x2C1B3C6D)
    x ^= x >> _NARROW(12)
    x *= _NARROW(0x297A2D39)
    return x ^ (x >> _NARROW(15))
