"""Hashes of many substrings at once, from sums over one array."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of an odd base and of its inverse, modulo 2**64."""
    size = 1 << (n - 1).bit_length()
    if size not in _powers:
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = up.cumprod(dtype=np.uint64), down.cumprod(dtype=np.uint64)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each number's bits, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sums_of(data: np.ndarray) -> np.ndarray:
    """Running sums of the values times the powers of their places."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def hashes_of(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A hash of each substring and its salt; equal substrings have equal hashes wherever they stand."""
    values = (sums[starts + lengths] - sums[starts]) * power_tables(len(sums))[1][starts]
    return mix(mix(values) + salts * np.uint64(0xC2B2AE3D27D4EB4F))
