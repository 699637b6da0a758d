"""Vectorised hashing of texts inside Arrow batches: characters, words, n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Texts are hashed in pieces of at most so many characters, cut at white space where there is any.
PIECE = 1 << 19


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in runs of at most size characters that end behind white space where possible; none for an empty text."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
        cut = cut if cut > at else at + size
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(max(n, 4096), 0x9E3779B97F4A7C15, U)
        step[0] = 1
        _POWERS = np.cumprod(step, dtype=U)
    return _POWERS[:n]


def word_hashes(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values of data (uint8 or uint32) where space is False, in order."""
    if not len(data):
        return np.empty(0, U)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, U)
    length = end - start
    inside = ~space
    position = np.arange(len(data))[inside] - np.repeat(start, length)
    value = (data[inside].astype(U) + U(1)) * powers(int(length.max()))[position]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix(np.add.reduceat(value, first) + length.astype(U) * U(0xD6E8FEB86659FD93))
