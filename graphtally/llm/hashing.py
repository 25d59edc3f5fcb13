"""Hashes of many byte spans at once, by mixing that is not linear in the bytes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of a span that are read as two words; longer spans go to the hash library one by one.
SHORT = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPREAD, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def short_words(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight and the next eight bytes of each span as numbers; a span of up to SHORT bytes is these and its size."""
    room = np.concatenate((b, np.zeros(24, np.uint8)))
    at = np.ndarray((len(b) + 16,), "<u8", room.data, 0, (1,))
    low = at[start] & _MASK[np.minimum(size, 8)]
    return low, at[start + 8] & _MASK[np.clip(size - 8, 0, 8)]


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each byte span; spans of up to eight bytes never share a value."""
    size = end - start
    low, high = short_words(b, start, size)
    with np.errstate(over="ignore"):
        out = mixed(low + size.astype(np.uint64) * _SPREAD)
        some = size > 8
        out[some] = mixed(out[some] * np.uint64(3) + mixed(high[some] ^ _SECOND))
    raw = memoryview(np.ascontiguousarray(b))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return out
