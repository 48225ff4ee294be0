"""Word shingles as 64-bit hashes, with NumPy over a text's bytes.

A word is a run of ASCII letters and digits and of bytes outside ASCII, in lower case; a shingle is
``size`` words in a row. A text with fewer words has one shingle of all of them, and one without
words has none.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_P = 0x100000001B3
_INV = pow(_P, -1, 1 << 64)
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _K1
    x = (x ^ (x >> np.uint64(33))) * _K2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_P, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    word = _IS_WORD[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of a whole text, ascending."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)
