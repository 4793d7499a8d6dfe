"""Polynomial hashes of all k-grams of a code-point array, and their landmarks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Odd multipliers of the hashes modulo 2^64.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


def gram_hashes(cps: np.ndarray, k: int) -> np.ndarray:
    """The hash of ``cps[i : i + k]`` for every i; grams don't heed row borders."""
    if len(cps) < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(12, int(len(cps)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.empty(len(cps) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(cps * up[: len(cps)], dtype=np.uint64, out=sums[1:])
        return mixed((sums[k:] - sums[:-k]) * down[: len(cps) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of ``x[i : i + w]`` for every i."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def blocks(offs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most`` code points each; a longer row is a run of its own."""
    out, a, n = [], 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out
