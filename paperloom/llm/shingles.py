"""Sets of word shingles of whole texts, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from paperloom.llm.common import mix, text_bytes

SHINGLE = 5
_FACTOR = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        grown = []
        for base in (_FACTOR, _INVERSE):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) of a batch of texts, and each text's first word."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    begins[edge] = inside[edge]  # words do not run over texts
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[flat]] * up[:n], out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text its distinct shingles' hashes in order: k words in a row; with fewer words, all of them
    as one shingle; nothing without words."""
    words, first = word_hashes(*text_bytes(column))
    windows = max(0, len(words) - k + 1)
    joint = np.zeros(windows, np.uint64)
    for i in range(k):
        joint = mix(joint + words[i : i + windows])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(joint[a : b - k + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for w in words[a:b]:
                one = mix(one + w)
            yield one
        else:
            yield np.zeros(0, np.uint64)
