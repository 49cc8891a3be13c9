"""Arrays as bytes, for rows that stand for many small ones."""

from __future__ import annotations

import numpy as np

from . import wordhash


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 with their bytes set apart, so that they compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def by_part(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys by part, and where each part begins."""
    home = (wordhash.mix(key) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(parts + 1))


def narrow(x: np.ndarray) -> bytes:
    """The upper 48 bits of 64-bit hashes; within one part these tell keys apart."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def widened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()
