"""Whole texts to token ids through a table of chunks.

A text is cut at places where its tokenizer surely cuts too, so the ids of a text are
the ids of its chunks in a row.  Chunks are looked up in a hash table per Python worker
(vectorised over a batch), and only chunks not met before go to the tokenizer.  Chunks
are told apart by content, never by a hash: those of up to SHORT bytes are their own key,
longer ones are keys of a dictionary.  The table is emptied when it holds ``MOST`` chunks,
``MOST_IDS`` ids or ``MOST_LONG`` bytes of long chunks, what Python needs for their keys
included, so memory has a bound whatever the text: about 200 MB.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .hashing import SHORT, short_words

#: Chunks kept in a worker's table, their ids, and bytes of the chunks beyond SHORT.
MOST, MOST_IDS, MOST_LONG = 1 << 21, 1 << 24, 1 << 25
#: Bytes that a key of the dictionary takes beside its chunk: the bytes object, the pair, the entry's number and their places.
PER_LONG = 256
#: Bytes cut and looked up at once: about 60 bytes of memory for each.
AT_ONCE = 1 << 20
#: New chunks that go to the tokenizer at once, whose results are Python objects.
NEW_AT_ONCE = 1 << 15

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
#: Second-last bytes that the UTF-8 forms of non-ASCII white space may have.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0x80, 0x81, 0x9A]] = True


def word_cuts(b: np.ndarray) -> np.ndarray:
    """Where a pattern of letter runs, digit runs, other runs and blank runs surely cuts.

    Before the first blank after a non-blank, and between a Latin letter and one of the
    marks .,;:!? -- never inside a contraction, a run of blanks or unsure characters.
    """
    cut = np.zeros(len(b), bool)
    if len(b) < 3:
        return cut
    last, before = b[1:-1], b[:-2]
    solid = _PLAIN[last] | ((last >= 0x80) & ~_UNSURE[before])
    letter = _LETTER[last] | ((before == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 0x80))
    cut[2:] = (_BLANK[b[2:]] & solid) | (_MARK[b[2:]] & letter)
    return cut


def space_cuts(b: np.ndarray) -> np.ndarray:
    """Before a space that follows neither a space nor the last byte of U+2581."""
    cut = np.zeros(len(b), bool)
    cut[1:] = (b[1:] == 32) & (b[:-1] != 32) & (b[:-1] != 0x81)
    return cut


class Chunked:
    """``encode``: (chunks, whether first in their text) to a list of id lists."""

    def __init__(self, encode: Callable[[list[str], list[bool]], list], cuts: Callable[[np.ndarray], np.ndarray]) -> None:
        self.tokens, self.cuts = encode, cuts
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.slot = np.full(1 << self.bits, -1, np.int32)
        # Room for a full table at once: zeros take no memory until they are written, a copy that grows takes all of it.
        self.key = [np.zeros(MOST, kind) for kind in (np.uint64, np.uint64, np.uint8)]  # the bytes of a short chunk, its size and place
        self.off = np.zeros(MOST, np.int64)
        self.len = np.zeros(MOST, np.int32)
        self.flat = np.zeros(MOST_IDS, np.uint32)
        self.long: dict[tuple[bytes, bool], int] = {}
        self.n = self.used = self.long_bytes = 0

    def _slots(self, k: tuple[np.ndarray, ...]) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (k[0] ^ k[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ k[2] << np.uint64(57)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, k: tuple[np.ndarray, ...]) -> np.ndarray:
        """Entry of each short chunk, -1 if there is none."""
        at = self._slots(k)
        out = self.slot[at]
        left = np.flatnonzero(out >= 0)
        while len(left):  # entries that are another chunk's: on to the next slot
            e = out[left]
            same = (self.key[0][e] == k[0][left]) & (self.key[1][e] == k[1][left]) & (self.key[2][e] == k[2][left])
            left = left[~same]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.slot[at[left]]
            left = left[out[left] >= 0]
        return out

    def _place(self, entries: np.ndarray) -> None:
        at = self._slots(tuple(x[entries] for x in self.key))
        while len(entries):
            free = self.slot[at] < 0
            self.slot[at[free]] = entries[free]  # of several that want one slot the last gets it
            lost = self.slot[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _add(self, keys: tuple[np.ndarray, ...], ids: list) -> np.ndarray:
        """New entries; those whose key says a size of up to SHORT can be found by it."""
        m, lens = len(ids), np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if m else np.zeros(0, np.uint32)
        while self.n + m > len(self.off):
            self.key, self.off, self.len = [np.concatenate((x, x)) for x in self.key], np.concatenate((self.off, self.off)), np.concatenate((self.len, self.len))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        new = np.arange(self.n, self.n + m, dtype=np.int32)
        self.len[new] = lens
        for x, own in zip(self.key, keys, strict=True):
            x[new] = np.minimum(own, np.iinfo(x.dtype).max).astype(x.dtype)  # any size beyond SHORT says the same
        self.off[new] = self.used + np.concatenate(([0], np.cumsum(lens[:-1], dtype=np.int64))) if m else 0
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += m
        if self.n * 2 > 1 << self.bits:
            self.bits += 2
            self.slot = np.full(1 << self.bits, -1, np.int32)
            every = np.arange(self.n, dtype=np.int32)
            self._place(every[self.key[2][: self.n] <= 2 * SHORT + 1])
        else:
            self._place(new[keys[2] <= 2 * SHORT + 1])
        return new

    def _group(self, b: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and each chunk's number of ids."""
        size = end - start
        k = (*short_words(b, start, size), (2 * size + first).astype(np.uint64))
        e = self._find(k)
        raw = memoryview(np.ascontiguousarray(b))
        long = np.flatnonzero(size > SHORT)
        names = {i: (bytes(raw[s:t]), f) for i, s, t, f in zip(*(x.tolist() for x in (long, start[long], end[long], first[long])), strict=True)}
        for i, name in names.items():
            e[i] = self.long.get(name, -1)
        if len(miss := np.flatnonzero(e < 0)):
            if self.n + len(miss) > MOST or self.used > MOST_IDS or self.long_bytes > MOST_LONG:
                self.clear()
                miss = np.arange(len(e))
            short = miss[size[miss] <= SHORT]
            order = short[np.lexsort([x[short] for x in k])]
            differs = np.zeros(max(0, len(order) - 1), bool)
            for x in k:
                differs |= x[order[1:]] != x[order[:-1]]
            new = order[np.concatenate(([True], differs))] if len(order) else order
            unmet = {names[i]: i for i in miss.tolist() if i in names}
            new = np.concatenate((new, np.fromiter(unmet.values(), np.int64, len(unmet))))
            added = [np.zeros(0, np.int32)]
            for low in range(0, len(new), NEW_AT_ONCE):
                some = new[low : low + NEW_AT_ONCE]
                ids = self.tokens([bytes(raw[i:j]).decode("utf-8", "replace") for i, j in zip(start[some].tolist(), end[some].tolist(), strict=True)], first[some].tolist())
                added.append(self._add(tuple(x[some] for x in k), ids))
            at = np.concatenate(added)[len(new) - len(unmet) :]
            for name, entry in zip(unmet, at.tolist(), strict=True):
                self.long[name] = entry
                self.long_bytes += len(name[0]) + PER_LONG
            e[short] = self._find(tuple(x[short] for x in k))
            for i in miss.tolist():
                if i in names:
                    e[i] = self.long[names[i]]
        lens = self.len[e].astype(np.int64)
        upto = np.cumsum(lens)
        return self.flat[np.repeat(self.off[e] - upto + lens, lens) + np.arange(int(upto[-1]) if len(upto) else 0)], lens

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text in order; null is the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(texts):
            upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1)
            own = offsets[row : upto + 1] - offsets[row]
            b = data[offsets[row] : offsets[upto]]
            cut = self.cuts(b)
            lead = own[:-1][own[1:] > own[:-1]]
            cut[lead] = True
            start = np.flatnonzero(cut)
            end = np.concatenate((start[1:], [len(b)])) if len(start) else start
            first = np.zeros(len(start), bool)
            first[np.searchsorted(start, lead)] = True
            ids, lens, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
            while i < len(start):  # one turn, but for a text beyond AT_ONCE
                j = max(i + 1, int(np.searchsorted(end, start[i] + AT_ONCE, "right")))
                if end[i] - start[i] > AT_ONCE:  # one chunk that large isn't hashed
                    got = [np.asarray(self.tokens([b[start[i] : end[i]].tobytes().decode("utf-8", "replace")], [bool(first[i])])[0], np.uint32)]
                    got.append(np.array([len(got[0])]))
                else:
                    got = self._group(b[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i], first[i:j])
                ids.append(got[0])
                lens.append(got[1])
                i = j
            flat, total = np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(lens))))
            edge = total[np.searchsorted(start, own)]
            for r in range(row, upto):
                yield r, flat[edge[r - row] : edge[r - row + 1]]
            row = upto


_kept: dict[tuple[str, int], Chunked] = {}


def bpe(vocabulary: str) -> Chunked:
    """A worker's encoder for the text of a ``tokenizers`` file, as its plain call encodes; no cut lies within a special string."""
    key = ("bpe", hash(vocabulary))
    if key not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary)

        def encode(chunks: list[str], first: list[bool]) -> list:
            """Chunks of a space and letters go together: each is one word of the pattern."""
            out: list = [None] * len(chunks)
            plain = [i for i, c in enumerate(chunks) if c[0] == " " and c[1:].isalpha()]
            for k in range(0, len(plain), 2000):
                some = plain[k : k + 2000]
                e = t.encode_batch(["".join(chunks[i] for i in some)], add_special_tokens=False)[0]  # the fast call has no word ids
                words, ids = np.asarray(e.word_ids, np.int64), np.asarray(e.ids, np.uint32)
                edges = np.searchsorted(words, np.arange(len(some) + 1))
                if len(words) and words[-1] + 1 == len(some) and (np.diff(edges) > 0).all():
                    for n, i in enumerate(some):
                        out[i] = ids[edges[n] : edges[n + 1]]
            rest = [i for i, x in enumerate(out) if x is None]
            for k in range(0, len(rest), 1000):
                for i, e in zip(rest[k : k + 1000], t.encode_batch_fast([chunks[i] for i in rest[k : k + 1000]], add_special_tokens=False), strict=True):
                    out[i] = e.ids
            return out

        _kept[key] = Chunked(encode, word_cuts)
    return _kept[key]
