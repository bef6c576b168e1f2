"""Words and shingles of whole texts as 64-bit numbers, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
FACTOR = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, _U)


def powers(n: int) -> np.ndarray:
    """``FACTOR ** (0 .. n-1)`` modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), FACTOR, _U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(steps)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: bytes, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, first byte, end byte, text number)`` of all words of the concatenated texts."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets[:-1]] = True
    border[len(data)] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | border[:-1]))
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none
    end = np.flatnonzero(inside & (~np.append(inside[1:], False) | border[1:])) + 1
    position = np.arange(len(data), dtype=np.int64) - np.repeat(start, np.diff(np.append(start, len(data))).clip(0)) if start[0] == 0 else (
        np.arange(len(data), dtype=np.int64) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(data))))]))
    value = (_LOWER[data] if lower else data).astype(_U) + _U(1)
    value[~inside] = 0
    length = end - start
    with np.errstate(over="ignore"):
        value *= powers(int(position.max()) + 1)[position]
        hashed = mix(np.add.reduceat(value, start) + length.astype(_U) * _U(0xD6E8FEB86659FD93))
    return hashed, start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(raw: bytes, offsets: np.ndarray, width: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text; a shorter text is one shingle."""
    hashed, _, _, text = words(raw, offsets, lower)
    first = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    with np.errstate(over="ignore"):
        for i in range(len(offsets) - 1):
            h = hashed[first[i]: first[i + 1]]
            n = min(len(h), width)
            if not n:
                out.append(np.zeros(0, _U))
                continue
            total = np.full(len(h) - n + 1, _U(n))
            for k in range(n):
                total = mix(total * FACTOR + h[k: len(h) - n + 1 + k])
            out.append(np.unique(total))
    return out
