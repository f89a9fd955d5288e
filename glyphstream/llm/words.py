"""Words of texts as bytes and as 64-bit numbers, for the operators that run in Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

try:
    from xxhash import xxh3_64_intdigest as _digest
except ImportError:
    import hashlib

    def _digest(x: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")


#: Lower-case Latin letters, digits and all that isn't ASCII.
PLAIN = re.compile(rb"[0-9a-z\x80-\xff]+")
KEPT = 200_000


class Numbers(dict):
    """Word to its 64-bit hash; the words seen are kept, up to KEPT of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        got = self[word] = _digest(word)
        return got


_numbers = Numbers()


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty."""
    return (text or "").encode().lower()


def plain_words(text: str | None) -> list[bytes]:
    return PLAIN.findall(lowered(text))


def numbered(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole number (the finaliser of a 64-bit mixing hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None


def give_back() -> None:
    """Returns memory that this worker has freed to the system: a worker lives on between tasks, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_held: dict[str, Callable[[], object]] = {}


def entering(name: str, clear: Callable[[], object] | None = None) -> None:
    """Tells a worker which operator it runs now: tables that other operators keep there are cleared, as workers live on from stage to stage."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    if others:
        give_back()
    if clear is not None:
        _held[name] = clear


def words_begin() -> None:
    """entering() for the operators that number words."""
    entering("words", _numbers.clear)


BASE = np.uint64(0x9E3779B97F4A7C15)


def windows(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words; none if there are fewer words."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = numbers[:n] * np.uint64(2 * width + 1)
    for k in range(1, width):
        out = mixed(out) if k % 4 == 0 else out
        out = out * BASE + numbers[k : k + n]
    return mixed(out)
