"""Vectorised 64-bit hashes of a text's words and word shingles."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE & _M, _INVERSE)]
    return _powers


def words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (in UTF-8) of each run of characters other than ASCII white space."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13)) & ((data < 28) | (data > 31))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.array([], np.uint64), start, end
    power, inverse = _powers_to(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


def shingles(w: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of ``k`` words in a row; of all words if there are fewer."""
    if not len(w):
        return np.array([], np.uint64)
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + w[i : i + n]
    return mix(h)


def occurrences(s: np.ndarray) -> np.ndarray:
    """How often the same value came before."""
    order = np.argsort(s, kind="stable")
    v = s[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.array([], bool)
    first = np.flatnonzero(new)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.concatenate([first, [len(s)]])))
    return out
