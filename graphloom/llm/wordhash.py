"""Vectorised 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import pandas as pd

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer (splitmix) on uint64."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
#: Digits, ASCII letters and every byte of a character beyond ASCII.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[0x30:0x3A] = WORDLIKE[0x41:0x5B] = WORDLIKE[0x61:0x7B] = WORDLIKE[0x80:] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 12)
            for name, base in (("up", self.base), ("down", self.inverse)):
                step = np.full(n, base, np.uint64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))
        return self.up, self.down


_BYTE, _WORD = _Powers(0x5851F42D4C957F2D | 1), _Powers(0xD1342543DE82EF95)


def spans(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which inside holds."""
    flag = np.zeros(len(raw) + 2, np.int8)
    flag[1:-1] = inside[raw]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def totals(raw: np.ndarray) -> np.ndarray:
    """Running sums from which any run of bytes can be hashed."""
    up, _ = _BYTE.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up[: len(raw)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _BYTE.upto(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space, in order.

    A keyed mixing hash: sums over powers of a base would give some long words one hash whatever the base.
    """
    word = data.split()
    return pd.util.hash_array(np.array(word, object), categorize=False) if word else np.empty(0, np.uint64)


def runs(word: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of n consecutive words."""
    if len(word) < n:
        return np.empty(0, np.uint64)
    up, down = _WORD.upto(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    salted = word if not seed else mix(word + U(seed))
    np.cumsum(salted * up[: len(word)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(word) - n + 1])


def stretches(word: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each stretch of words, of any length."""
    up, down = _WORD.upto(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(mix(word + U(seed)) * up[: len(word)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
