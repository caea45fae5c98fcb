"""Hashes of all words of a text at once, in numpy. Words stand between ASCII blanks."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, by doubling."""
    for i, base in enumerate((BASE, _INVERSE)):
        while len(_POWERS[i]) < n:
            have = len(_POWERS[i])
            _POWERS[i] = np.concatenate((_POWERS[i], _POWERS[i] * np.uint64(pow(base, have, 1 << 64))))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    b = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(text: bytes | np.ndarray) -> np.ndarray:
    """64 bits for each word: differences of one running polynomial over the bytes."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    start, end = words_of(b)
    power, inverse = _powers(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """64 bits for each run of ``length`` words, by differences of one running polynomial."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)))
    n = len(words) - length + 1
    return mix((total[length:] - total[:n]) * inverse[:n])
