"""Runs: maximal periodic stretches of words, by longest previous factors, block boundaries and copying.

Several texts are worked on at once, words as numbers that no two texts share:

* suffixes are sorted by prefix doubling; only those that still share their prefix with
  another are sorted on.  The names of all prefixes of 2**j words are kept, and tell how far
  two positions agree, onwards or backwards, in steps of halving size.
* a suffix's longest previous factor is the longer agreement with the nearest suffixes,
  before and after it in that order, that start earlier in the text: nearest smaller
  positions over the suffix array, with the least LCP on the way.
* the factors one after another cut a text into LZ blocks.  A run either touches the
  boundary of the block that holds its last word, or its own end is a boundary, or it
  lies inside of a block with a word to spare on either side.
* the first two kinds come from Main's extensions: at a boundary, for each period up to the
  lengths of the blocks beside it, how far the words agree with those one period away.
  A run that starts before a block is shorter by less than a period than from the start
  of the block before, or that block would have been longer; so no further period is needed.
* the third kind is copied: a block repeats an earlier place, and so do the runs inside it.
  Runs lie in buckets by their start, taken in rising order, so that copies of copies are met.

A period found may be a multiple of the smallest; that names the same stretch, and the least
period of a stretch stays.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words worked on at once; a longer text is worked on alone.
AT_ONCE = 1 << 19

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


@dataclass(frozen=True)
class Runs:
    """A run has at least ``least`` words and two periods."""

    least: int = 12


class Agreements:
    """Suffix array of several texts and the names of their prefixes of 2**j words.

    ``names``: a number for each position; texts share none, and each text ends in a
    number that occurs once.
    """

    def __init__(self, names: np.ndarray) -> None:
        n = len(names)
        size = np.bincount(names, minlength=n)
        place = np.cumsum(size) - size
        order = np.argsort(names, kind="stable")
        rank = place[names].astype(np.int32)
        self.order, self.names = order.astype(np.int32), [rank]
        open_ = order[size[names[order]] > 1]  # by rank
        step = 1
        while len(open_):
            old = rank[open_].astype(np.int64)
            # Both agree for ``step`` words, so neither has met its text's end, and the next name is there.
            key = old * n + rank[open_ + step]
            by = np.argsort(key, kind="stable")
            key, open_, old = key[by], open_[by], old[by]
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            first = np.ones(len(key), bool)
            first[1:] = old[1:] != old[:-1]
            at = np.arange(len(key))
            place = old + at - np.maximum.accumulate(np.where(first, at, 0))
            self.order[place] = open_
            rank = rank.copy()
            rank[open_] = np.maximum.accumulate(np.where(fresh, place, 0))
            self.names.append(rank)
            alone = fresh & np.append(fresh[1:], True)
            open_, step = open_[~alone], step * 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and b (different positions) on."""
        return self._agree(a, b, 1)

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before a and b."""
        return self._agree(a, b, -1)

    def _agree(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """Doubling steps while whole blocks agree, then halving ones."""
        a, b, n = a.astype(np.int64), b.astype(np.int64), len(self.names[0])

        def same(j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            if way < 0:
                x, y = x - (1 << j), y - (1 << j)
                inside = (x >= 0) & (y >= 0)
                return inside & (self.names[j][np.maximum(x, 0)] == self.names[j][np.maximum(y, 0)])
            inside = (x < n) & (y < n)
            return inside & (self.names[j][np.minimum(x, n - 1)] == self.names[j][np.minimum(y, n - 1)])

        out, level = np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64)
        some = np.arange(len(a))
        for j in range(len(self.names)):
            some = some[same(j, a[some], b[some])]
            if not len(some):
                break
            level[some] = j
        some = np.flatnonzero(level >= 0)
        out[some] = np.int64(1) << level[some]
        for j in range(int(level.max(initial=-1)) - 1, -1, -1):
            own = some[level[some] > j]
            own = own[same(j, a[own] + way * out[own], b[own] + way * out[own])]
            out[own] += 1 << j
        return out


def previous_factors(s: Agreements) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest factor that starts at each position and at an earlier one; place -1 for none."""
    order = s.order.astype(np.int64)
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)  # lcp[r]: suffixes r-1 and r of the order
    near = np.flatnonzero(s.names[0][order[1:]] == s.names[0][order[:-1]]) + 1
    lcp[near] = s.ahead(order[near - 1], order[near])

    def nearest(step: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the nearest suffix of smaller position on one side, and what it shares (0: none)."""
        at = np.arange(n) + step
        least = lcp[:-1].copy() if step < 0 else lcp[1:].copy()
        some = np.flatnonzero(least > 0)
        some = some[order[at[some]] > order[some]]
        while len(some):
            # What lies between ``at`` and its own candidate starts later still, so it can be jumped over.
            hop = at[some]
            shared, to = np.minimum(least[some], least[hop]), at[hop]
            least[some], at[some] = shared, to
            some = some[shared > 0]
            some = some[order[at[some]] > order[some]]
        return at, least

    (low, shares), (high, shares2) = nearest(-1), nearest(1)
    better = shares >= shares2
    length, rank = np.where(better, shares, shares2), np.where(better, low, high)
    size, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    size[order] = length
    some = length > 0
    place[order[some]] = order[rank[some]]
    return size, place


def blocks(jump: list[int], begin: int, end: int) -> list[int]:
    """Starts of the LZ blocks of a text, and its end."""
    out = []
    while begin < end:
        out.append(begin)
        begin += jump[begin] or 1
    out.append(end)
    return out


def boundary_runs(s: Agreements, boundary: np.ndarray, before: np.ndarray, after: np.ndarray, p: Runs) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a boundary, by Main's extensions; ``before`` and ``after`` are the blocks' lengths."""
    found = []
    # The half of the run that holds a whole period lies after the boundary, or before it.
    for onwards, most in ((True, after), (False, before + after)):
        for low in range(0, len(boundary), AT_ONCE):
            k = most[low : low + AT_ONCE]
            for at, period in _periods(boundary[low : low + AT_ONCE], k):
                x, y = (at, at + period) if onwards else (at - period, at)
                touch = s.names[0][x] == s.names[0][y]
                touch |= (x > 0) & (s.names[0][np.maximum(x, 1) - 1] == s.names[0][np.maximum(y, 1) - 1])
                x, y, q = x[touch], y[touch], period[touch]
                back, ahead = s.back(x, y), s.ahead(x, y)
                size = back + ahead + q
                keep = size >= np.maximum(p.least, 2 * q)
                found.append(np.column_stack((x - back, y + ahead, q))[keep])
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return _least_periods(rows)


def _periods(boundary: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(boundary, period) for all periods up to each boundary's most, so many pairs at a time."""
    total = np.cumsum(most)
    low = 0
    while low < (total[-1] if len(total) else 0):
        high = min(int(total[-1]), low + 4 * AT_ONCE)
        k = np.arange(low, high)
        i = np.searchsorted(total, k, "right")
        yield boundary[i], k - (total[i] - most[i]) + 1
        low = high


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """One row a stretch, that of the least period, by start, then end."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[fresh]


def copied_runs(runs: list[tuple[int, int, int]], cuts: list[int], place: list[int], p: Runs) -> list[tuple[int, int, int]]:
    """All runs of a text, from those that touch boundaries, by start, then end: a block holds the runs of the place that it repeats.

    ``place`` of each block's start, in the order of ``cuts``.
    """
    buckets: dict[int, set[tuple[int, int]]] = {}
    for start, end, period in runs:
        buckets.setdefault(start, set()).add((end, period))
    starts = sorted(buckets)
    for begin, end, source in zip(cuts, cuts[1:], place, strict=False):
        if source < 0 or end - begin < p.least + 2:
            continue
        shift = begin - source
        i = bisect.bisect_right(starts, source)
        while i < len(starts) and starts[i] + shift < end:
            start = starts[i]
            for e, q in list(buckets[start]):
                if e + shift < end:
                    if start + shift not in buckets:
                        buckets[start + shift] = set()
                        bisect.insort(starts, start + shift)
                    buckets[start + shift].add((e + shift, q))
            i += 1
    return sorted((start, e, q) for start in starts for e, q in buckets[start])


def runs_of(texts: list[list[bytes]], p: Runs = Runs()) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of every run of each text of words, by start, then end."""
    edge = np.cumsum([0] + [len(t) + 1 for t in texts])
    names = np.empty(int(edge[-1]), np.int64)
    for t, low in zip(texts, edge.tolist(), strict=False):
        known: dict[bytes, int] = {}
        # A word's number is the place where the text has it first.
        names[low : low + len(t)] = np.fromiter(map(known.setdefault, t, count(low)), np.int64, len(t))
        names[low + len(t)] = low + len(t)
    s = Agreements(names)
    size, place = previous_factors(s)
    jump = size.tolist()
    cuts = [blocks(jump, low, low + len(t)) for t, low in zip(texts, edge.tolist(), strict=False)]
    flat = np.concatenate([np.array(c, np.int64) for c in cuts])
    first = np.cumsum([0] + [len(c) for c in cuts])
    length = np.diff(flat, append=flat[-1])
    after = length.copy()
    after[first[1:] - 1] = 0
    before = np.zeros(len(flat), np.int64)
    before[1:] = after[:-1]
    own = np.repeat(edge[:-1], np.diff(first))
    # No period reaches over the text's ends.
    ahead = np.minimum(after, np.repeat(edge[1:], np.diff(first)) - 1 - flat)
    touching = boundary_runs(s, flat, np.minimum(before + ahead, flat - own) - ahead, ahead, p)
    part = np.searchsorted(touching[:, 0], edge)
    out = []
    for i, low in enumerate(edge[:-1].tolist()):
        rows = touching[part[i] : part[i + 1]]
        if not len(rows):
            out.append([])
            continue
        found = copied_runs(list(map(tuple, rows.tolist())), cuts[i], place[cuts[i][:-1]].tolist(), p)
        out.append([(a - low, b - low, q) for a, b, q in found])
    return out


def tail_repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in a tenth of the ids (by crc32 of the id) with a tail made to repeat; a null id's stay."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + period]
    return (words[:a] + unit * ((n - a) // period + 1))[:n]


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_dropped)."""
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    longest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    rows = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = words
    if runs:
        mark = np.zeros(len(words) + 1, np.int64)
        for a, b, q in runs:
            mark[a + q] += 1
            mark[b] -= 1
        kept = [w for w, m in zip(words, np.cumsum(mark).tolist(), strict=False) if not m]
    return (len(runs), *longest, hashlib.sha256(rows.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(words) - len(kept))


def _grouped(ids: list, texts: list) -> Iterator[tuple[list, list[list[bytes]]]]:
    own, words, n = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        some = (t or b"").split()  # the six ASCII blanks
        if own and n + len(some) > AT_ONCE:
            yield own, words
            own, words, n = [], [], 0
        own.append(i), words.append(some)
        n += len(some)
    if own:
        yield own, words


def periodic_runs(docs: DataFrame, p: Runs = Runs(), tails: bool = False) -> DataFrame:
    """A digest of every row's runs (SCHEMA) from its doc_id and text; further columns are ignored.

    Words lie between ASCII blanks and are compared whole.  A null text has no words; a
    text without runs has null longest run and the digest of nothing.  Equal rows give equal
    rows, an empty table none.  ``tails`` has the words of a tenth of the ids repeat first.
    A text is one task's, whatever its length; a word takes some hundred bytes there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            for ids, words in _grouped(batch.column("doc_id").to_pylist(), texts.to_pylist()):
                if tails:
                    words = [tail_repeated(w, i) for i, w in zip(ids, words, strict=True)]
                rows = [digest(w, r) for w, r in zip(words, runs_of(words, p), strict=True)]
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
                columns = [pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, SCHEMA)
