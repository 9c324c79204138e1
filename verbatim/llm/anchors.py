"""Anchors: places in a text that its bytes alone decide, at least one in every string of a given length."""

from __future__ import annotations

import numpy as np

#: Bytes of a repeated string, bytes that an anchor's hash covers, and places in such a string where it may be.
LENGTH = 50
SEED_BYTES = 24
PLACES = LENGTH - SEED_BYTES + 1


def _loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        own = raw[k : k + (n - k + 7) // 8 * 8] if n > k else raw[:0]
        out[k::8] = own.view("<u8") if len(own) else 0
    return out


def hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED_BYTES bytes from each place on."""
    word = _loads(raw)
    n = len(raw) - SEED_BYTES + 1
    return _mixed(word[:n], word[8 : n + 8], word[16 : n + 16])


def hashes_at(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The hashes of some places alone."""
    if not len(at):
        return np.zeros(0, np.uint64)
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return _mixed(word[at], word[at + 8], word[at + 16])


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h += c
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n places in turn, by doubling."""
    reach = 1
    while reach * 2 <= n:
        x = op(x[:-reach], x[reach:])
        reach *= 2
    return op(x[: len(x) - (n - reach)], x[n - reach :]) if reach < n else x


def anchors(raw: np.ndarray, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors and their hashes: the places whose hash is the least of some PLACES in a row.

    Equal least hashes are all taken. So any two equal strings of LENGTH bytes have an anchor at the
    same place in both. Worked on in overlapping stretches that a processor's cache holds.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    if len(raw) >= LENGTH:
        for start in range(0, len(raw), step):
            low = max(0, start - PLACES + 1)
            at, h = _stretch(raw[low : start + step + LENGTH - 1])
            at += low
            own = (at >= start) & (at < start + step)
            found.append((at[own], h[own]))
    return np.concatenate([a for a, _ in found]), np.concatenate([h for _, h in found])


def _stretch(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes(raw)
    order = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = _sliding(order, PLACES, np.minimum)
    edge = np.zeros(PLACES - 1, np.uint32)
    most = _sliding(np.concatenate([edge, least, edge]), PLACES, np.maximum)
    at = np.flatnonzero(most == order)
    return at, h[at]
