"""Hashes of many substrings at once, as differences of prefix sums of values times powers, modulo 2^64."""

from __future__ import annotations

import numpy as np

ROOT, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2^64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, x in (("up", ROOT), ("down", pow(ROOT, -1, 1 << 64))):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(32))
