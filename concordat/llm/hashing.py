"""Polynomial hashes of many byte ranges at once, modulo 2**64."""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # any odd numbers
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    known = _POWERS.get((base, inverse))
    if known is None or len(known) < n:
        step = np.full(max(n, 1 << 20), _U(pow(base, -1, 1 << 64) if inverse else base))
        step[0] = 1
        known = _POWERS[base, inverse] = np.multiply.accumulate(step)
    return known[:n]


def release() -> None:
    """Forget the powers; they are made again when needed."""
    _POWERS.clear()


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of value times power over every beginning of ``values``."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def of_ranges(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the ranges: equal for equal contents, wherever they lie."""
    return mixed((sums[stop] - sums[start]) * powers(base, len(sums), True)[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))
