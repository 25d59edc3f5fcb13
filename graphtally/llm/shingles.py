"""Word-shingle sets of whole texts as sorted arrays of 64-bit hashes, vectorised over a batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .chunks import _BLANK
from .hashing import mixed, span_hashes

#: Bytes of texts worked on at once.
AT_ONCE = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of strings; null is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(texts.buffers()[2] or b"", np.uint8)


def groups(offsets: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes."""
    row = 0
    while row < len(offsets) - 1:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, upto
        row = upto


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, edges, hashes): row first+i has hashes[edges[i]:edges[i+1]], distinct and ascending.

    Words lie between ASCII blanks, A-Z lowered.  Fewer than k words are one shingle;
    none give the empty set.
    """
    with np.errstate(over="ignore"):
        offsets, data = buffers(texts)
        spread = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
        for row, upto in groups(offsets):
            own = offsets[row : upto + 1] - offsets[row]
            b = _LOWER[data[offsets[row] : offsets[upto]]]
            n = len(b)
            solid = np.zeros(n + 2, bool)
            solid[1:-1] = ~_BLANK[b]
            edge = np.zeros(n + 1, bool)
            edge[own] = True
            start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
            end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
            w = span_hashes(b, start, end)
            doc = np.searchsorted(own, start, "right") - 1
            words = np.bincount(doc, minlength=upto - row)
            m = max(0, len(w) - k + 1)
            h = np.zeros(m, np.uint64)
            for j in range(k):
                h += mixed(w[j : j + m] + spread[j % 8] * np.uint64(2 * (j // 8) + 1)) * spread[(j + 3) % 8]
            whole = doc[:m] == doc[k - 1 : k - 1 + m]
            h, at = mixed(h[whole]), doc[:m][whole]
            first = np.concatenate(([0], np.cumsum(words)))
            short = np.flatnonzero((words > 0) & (words < k))
            few = np.array([int.from_bytes(hashlib.blake2b(w[first[i] : first[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
            h, at = np.concatenate((h, few)), np.concatenate((at, short))
            order = np.lexsort((h, at))
            h, at = h[order], at[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
            h, at = h[fresh], at[fresh]
            yield row, np.searchsorted(at, np.arange(upto - row + 1)), h
