"""Vectorised hashing of the words of one text.

Words are maximal runs of bytes outside the ASCII white space set
``\\x20 \\x09-\\x0D``; UTF-8 continuation bytes never fall into that set, so the
byte view and the code-point view give the same words.  A word's hash is a
position-weighted sum of per-byte random values modulo 2**64, mixed at the end;
it depends on nothing but the word's bytes, so that every executor gets the
same values.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE_VALUE = np.random.RandomState(20240229).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: invertible modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class PowerTable:
    """Powers of the base and of its inverse, grown as longer texts arrive."""

    def __init__(self, start: int = 1 << 16) -> None:
        self.up, self.down = powers(_BASE, start), powers(_INVERSE, start)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n).bit_length()
            self.up, self.down = powers(_BASE, size), powers(_INVERSE, size)
        return self.up, self.down


_TABLE = PowerTable()


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the first byte of each word and of the byte after it."""
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(text: str | None, fold_case: bool = False) -> np.ndarray:
    """One uint64 for each word of the text, in order; empty without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if fold_case:
        raw = _LOWER[raw]
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    keep = ~_SPACE[raw]
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    up, _ = _TABLE.to(int(lengths.max()) + 1)
    place -= np.repeat(first, lengths)
    value = _BYTE_VALUE[raw[keep]] * up[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words, by starting word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _TABLE.to(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    return mix((sums[size:] - sums[:-size]) * down[:n])


def shingles(text: str | None, size: int, fold_case: bool = True) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    A text with fewer words than ``size`` has its whole sequence as its only
    shingle; one without words has none.
    """
    words = word_hashes(text, fold_case)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(size, len(words))))
