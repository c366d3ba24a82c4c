"""Sets of word shingles as 64-bit fingerprints, computed for whole texts in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
#: Fixed values, odd: base of the word polynomial, its inverse, and place factors.
BASE = 0x9E3779B97F4A7C15
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, base & (2**64 - 1), U)]))


_POWER = _powers(BASE, PIECE)
_INVERSE = _powers(pow(BASE, -1, 2**64), PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * PLACES[0]
    x = (x ^ (x >> U(27))) * PLACES[1]
    return x ^ (x >> U(31))


def _hash_words(data: np.ndarray) -> np.ndarray:
    """Fingerprints of the words of folded bytes, in order."""
    global _POWER, _INVERSE
    if len(data) >= len(_POWER):  # a word of over a megabyte
        _POWER, _INVERSE = _powers(BASE, len(data)), _powers(pow(BASE, -1, 2**64), len(data))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _POWER[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * _INVERSE[start] + (end - start).astype(U) * PLACES[4])


def word_hashes(text: bytes | memoryview) -> np.ndarray:
    """Fingerprints of a text's words, A-Z lower-cased; worked off in pieces cut at white space."""
    data = _FOLD[np.frombuffer(text, np.uint8)]
    if len(data) <= PIECE:
        return _hash_words(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE - 1, len(data))
        gaps = np.flatnonzero(_SPACE[data[at:end]]) if end < len(data) else ()
        if end < len(data):
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) if len(later) else len(data)
        out.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles of `size` words; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    total = np.full(n - size + 1, U(size), U)
    for k in range(size):
        total += words[k : n - size + 1 + k] * PLACES[k]
        total = mix(total)
    return np.unique(total)


def sets_of(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text of a string column; of a null, the empty set."""
    for x in column.cast(pa.large_binary()):
        yield shingle_set(word_hashes(x.as_buffer() if x.is_valid else b""), size)
