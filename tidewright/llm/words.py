"""Words of whole batches as 64-bit hashes, by numpy: no Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _pow(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the first two million are kept for the next batch."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in a row and where each value begins and the last ends; null is as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (run of bytes other than 0x20 and 0x09-0x0D, never across texts), and the first word of each text."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return begin, end, np.searchsorted(begin, bounds)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * _pow(_BASE, n), out=sums[1:])
    return mix((sums[end] - sums[begin]) * _pow(_INVERSE, n + 1)[begin] + (end - begin).astype(np.uint64))


def exact_word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word as it stands; the sum of powers is left to words of up to 64 bytes, as long ones can be made to agree."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _pow(_BASE, n), out=sums[1:])
    out = mix((sums[end] - sums[begin]) * _pow(_INVERSE, n + 1)[begin] + (end - begin).astype(np.uint64))
    for w in np.flatnonzero(end - begin > 64).tolist():
        out[w] = xxhash.xxh3_64_intdigest(data[begin[w] : end[w]].tobytes())
    return out


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the first word of each text (one more entry than texts)."""
    data, bounds = text_bytes(column)
    begin, end, first = word_spans(data, bounds)
    return word_hashes(data, begin, end), first
