"""Word shingles of whole texts as sets of 64-bit numbers."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TWIST = np.uint64(0xD1B54A32D192ED03)
_BYTES = np.random.default_rng(20260101).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for reuse while short."""
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 17)
        made = np.full(size, base, dtype=np.uint64)
        made[0] = 1
        made = np.cumprod(made, dtype=np.uint64)
        if size > 1 << 20:
            return made[:n]
        _powers[key] = made
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _TWIST
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word; A-Z count as a-z, words end at ASCII blanks."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[data], [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * _power(_BASE, len(data)), dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _power(_BACK, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : i + n]
    return np.unique(mix(out))


def set_id(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()
