"""Prefix polynomial hashes over bytes, vectorised, modulo 2**64 with random byte values and a final mix.

prefix[i] holds the sum of value[byte j] * BASE**j for j < i, so a span's hash is a difference times an inverse power:
equal spans have equal hashes wherever they stand, and no span is copied.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
U = np.uint64
_tables: dict[str, np.ndarray] = {}


def values(seed: int) -> np.ndarray:
    """Random odd 64-bit values for the 256 bytes."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def powers(n: int, name: str = "up") -> np.ndarray:
    """BASE**0 .. BASE**(n - 1), or of its inverse with name "down"."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        step = BASE if name == "up" else pow(BASE, -1, 2**64)
        have = np.full(max(n, 1 << 16) * 5 // 4, U(step))
        have[0] = U(1)
        _tables[name] = have = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def prefixes(vals: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vals) + 1, np.uint64)
    np.cumsum(vals * powers(len(vals)), out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), "down")[start])
