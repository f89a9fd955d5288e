"""Shingle sets of texts and their b-bit MinHash signatures."""

from __future__ import annotations

import numpy as np

from .words import lowered, mixed, numbered, windows

WIDTH = 5
POSITIONS = 64
_SEEDS = mixed(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64))
_MULTIPLY, _ADD = (_SEEDS[:POSITIONS] | np.uint64(1))[:, None], _SEEDS[POSITIONS:][:, None]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, without words none."""
    words = lowered(text).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(numbered(words), min(width, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The lowest 32 bits of the least value of each of POSITIONS hash functions, as int32; blocks bound the memory."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096] * _MULTIPLY + _ADD).min(axis=1))
    return (mixed(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set: two sums over differently mixed members."""
    a = int(mixed(shingles + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(mixed(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
    return a - (1 << 63), b - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 85) -> bool:
    """100 * intersection >= percent * union, on full sets; two empty sets aren't linked."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
