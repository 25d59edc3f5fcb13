"""Exact encoding for merge-type SentencePiece models, by backtracking.

The longest vocabulary entry at a position is tried first (one automaton pass finds all
entries that end or start anywhere); a token may follow another only if merging their
joined text again keeps the border between them; positions known to fail are bits of
a field, so no position is tried twice.  The first full cover found this way is the
one that merging pair by pair would give.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunked, space_cuts

SPACE = "▁"


class MergeModel:
    """A model's vocabulary: entries, scores, byte ids, and the compatibility of neighbours."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.lib.get_piece_size()
        self.text = [self.lib.id_to_piece(i) for i in range(n)]
        self.score = [self.lib.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.match = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.match.add_word(piece, (len(piece), i))
        self.match.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}

    def merge(self, text: str) -> list[str]:
        """The text merged pair by pair: best score first, leftmost among equals."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (e := self.id.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[e], i, len(parts[i]), len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if len(parts[i]) != a or j >= len(parts) or len(parts[j]) != b or not a:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def parents(self, token: int) -> tuple[int, int] | None:
        """The two entries whose merge makes the token; None for a character or a token no merge makes."""
        if token not in self._split:
            text, found = self.text[token], None
            if len(text) > 1:
                # Merge all but the last step: the pair that is left is the last merge.
                kept, self.id = self.id, _Without(self.id, text)
                try:
                    two = self.merge(text)
                finally:
                    self.id = kept
                if len(two) == 2 and two[0] in self.id and two[1] in self.id:
                    found = (self.id[two[0]], self.id[two[1]])
            self._split[token] = found
        return self._split[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined text again gives just these two tokens."""
        key = (left, right)
        got = self._fits.get(key)
        if got is None:
            got = self._fits[key] = self._border_holds(left, right)
            if len(self._fits) > 1 << 20:
                self._fits = {key: got}
        return got

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo merges at the border, latest first; an entry that could have formed across it first breaks it."""
        limit, also = float("-inf"), False
        while True:
            across = self.id.get(self.text[left] + self.text[right])
            if across is not None and (self.score[across] > limit or (also and self.score[across] == limit)):
                return False
            a, b = self.parents(left), self.parents(right)
            if a is None and b is None:
                return True
            # The later merge is the one of lower score; of equals the right one (leftmost merges first).
            if b is None or (a is not None and self.score[left] < self.score[right]):
                limit, also, left = self.score[left], False, a[1]
            else:  # an equal merge across the border lies further left than the one undone, and so came first
                limit, also, right = self.score[right], True, b[0]

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised text (spaces as U+2581)."""
        n = len(text)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, token) in self.match.iter(text):
            ends[end - size + 1].append((size, token))
        out: list[int] = []
        at = 0
        while at < n:  # characters without an entry stand alone and split the text
            stop = at
            while stop < n and text[stop] in self.id:
                stop += 1
            if stop > at:
                found = self._cover(ends, at, stop)
                out += found if found is not None else self._ids(self.merge(text[at:stop]))
            if stop < n:
                out += self._spelled(text[stop])
            at = stop + 1
        return out

    def _cover(self, ends: list[list[tuple[int, int]]], at: int, stop: int) -> list[int] | None:
        failed, base = bytearray((stop - at) // 8 + 1), at
        tokens: list[int] = []
        places: list[int] = []
        choice = [len(ends[at]) - 1]  # the longest entry that starts here comes last
        while at < stop:
            options, k, moved = ends[at], choice[-1], False
            while k >= 0:
                size, token = options[k]
                k -= 1
                if at + size > stop or failed[(at + size - base) >> 3] >> ((at + size - base) & 7) & 1 or (tokens and not self.fits(tokens[-1], token)):
                    continue
                choice[-1] = k
                tokens.append(token)
                places.append(at)
                at += size
                if at < stop:
                    choice.append(len(ends[at]) - 1)
                moved = True
                break
            if not moved:
                failed[(at - base) >> 3] |= 1 << ((at - base) & 7)
                choice.pop()
                if not tokens:
                    return None
                tokens.pop()
                at = places.pop()
        return tokens

    def _spelled(self, char: str) -> list[int]:
        if not self.byte:
            return [self.lib.unk_id()]
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    def _ids(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.id[p]] if p in self.id else self._spelled(p))]


class _Without(dict):
    """The entries but one."""

    def __init__(self, entries: dict[str, int], but: str) -> None:
        self._entries, self._but = entries, but

    def get(self, key: str, default=None):  # noqa: ANN001, ANN201
        return default if key == self._but else self._entries.get(key, default)


_models: dict[int, tuple[MergeModel, Chunked]] = {}


def model(proto: bytes) -> tuple[MergeModel, Chunked]:
    """A worker's model and chunk table."""
    key = hash(proto)
    if key not in _models:
        m = MergeModel(proto)

        def encode(chunks: list[str], first: list[bool]) -> list[list[int]]:
            return [m.encode((SPACE if f else "") + c.replace(" ", SPACE)) for c, f in zip(chunks, first, strict=True)]

        _models[key] = (m, Chunked(encode, space_cuts))
    return _models[key]


def encoded(docs: DataFrame, proto: bytes) -> DataFrame:
    """doc_id, ids (little-endian, 32 bits), decoded: every text through ``encode``, back through the library's decoder.

    For models without normalisation, with a dummy prefix and byte fallback.  Null text
    is empty and has no ids; rows are independent, nothing moves between tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proto)  # a vocabulary file, not data

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, encode = model(shared.value)
        for batch in batches:
            out = [(ids.astype("<u4").tobytes(), m.lib.decode(ids.tolist())) for _, ids in encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, proto: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encoded``, without moving ids out of the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, encode = model(shared.value)
        decimal = np.array([str(i) for i in range(m.lib.get_piece_size())], object)
        for batch in batches:
            out = []
            for _, ids in encode(batch.column(1)):
                out.append((len(ids), hashlib.sha256(",".join(decimal[ids].tolist()).encode()).hexdigest(), hashlib.sha256(m.lib.decode(ids.tolist()).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
