"""Token ids in wavelet-matrix files: one file image per shard of consecutive documents.

Layout (little endian): ``magic, length of the head`` then a zstd head (counts, zeros per
level, document table, rank directory, block table), then the bit-planes in zstd blocks
of BLOCK bytes.  A lookup unpacks only the blocks it touches.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import bpe
from .common import written

MAGIC = b"WVLT0001"
#: Bytes of a plane in one compressed block; also the stride of the rank directory.
BLOCK = 1 << 13
#: A shard closes with the document that brings it to this many ids.
SHARD = 1 << 20

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file image of ``ids``, with the table of the documents they belong to."""
    n, levels = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    now, zeros, ranks, blocks, body = np.asarray(ids, np.uint16 if levels <= 16 else np.uint32), [], [], [], []
    pack = zstandard.ZstdCompressor(level=1)
    for level in range(levels - 1, -1, -1):
        one = ((now >> level) & 1).view(np.uint16 if levels <= 16 else np.uint32).astype(bool)
        plane = np.packbits(one, bitorder="little")
        edges = np.arange(0, len(plane), BLOCK)
        ranks.append(np.concatenate(([0], np.cumsum(np.add.reduceat(_POP[plane], edges, dtype=np.int64)))) if n else np.zeros(1, np.int64))
        raw = plane.tobytes()
        for i in edges:
            body.append(pack.compress(raw[i : i + BLOCK]))
            blocks.append(len(body[-1]))
        other = now[~one]
        zeros.append(len(other))
        now = np.concatenate((other, now[one]))
    known = [0 if d is None else d for d in doc_ids]
    head = json.dumps({"n": n, "levels": levels, "zeros": zeros, "docs": len(doc_ids), "null": [i for i, d in enumerate(doc_ids) if d is None]}).encode()
    parts = [np.asarray(known, "<i8"), np.asarray(lengths, "<i8"), np.concatenate(ranks).astype("<i8"), np.asarray(blocks, "<i4")]
    head = pack.compress(struct.pack("<I", len(head)) + head + b"".join(p.tobytes() for p in parts))
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


class WaveletMatrix:
    """Reads a file image: ``access``, ``rank``, ``select``, ``count``, ``occurrences``, ``decode``."""

    def __init__(self, image: bytes) -> None:
        if image[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = struct.unpack_from("<I", image, 8)[0]
        self._unpack = zstandard.ZstdDecompressor()
        head = self._unpack.decompress(image[12 : 12 + size])
        m = struct.unpack_from("<I", head)[0]
        meta = json.loads(head[4 : 4 + m])
        self.n, self.levels, self.zeros = meta["n"], meta["levels"], meta["zeros"]
        d, per = meta["docs"], -(-(-(-self.n // 8)) // BLOCK)
        at = 4 + m
        ids = np.frombuffer(head, "<i8", d, at)
        none = set(meta["null"])
        self.doc_ids: list[int | None] = [None if i in none else int(x) for i, x in enumerate(ids)]
        self.lengths = np.frombuffer(head, "<i8", d, at + 8 * d)
        at += 16 * d
        self._ranks = np.frombuffer(head, "<i8", self.levels * (per + 1), at).reshape(self.levels, per + 1)
        sizes = np.frombuffer(head, "<i4", self.levels * per, at + 8 * self.levels * (per + 1))
        self._from, self._per, self._image = 12 + size + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), per, image
        self._open: dict[int, np.ndarray] = {}

    def _block(self, level: int, i: int) -> np.ndarray:
        k = level * self._per + i
        if k not in self._open:
            if len(self._open) > 256:
                self._open.clear()
            self._open[k] = np.frombuffer(self._unpack.decompress(self._image[self._from[k] : self._from[k + 1]]), np.uint8)
        return self._open[k]

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, (i >> 3) // BLOCK)[(i >> 3) % BLOCK] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i."""
        b, byte = (i >> 3) // BLOCK, (i >> 3) % BLOCK
        got = int(self._ranks[level][b])
        if byte or i & 7:
            block = self._block(level, b)
            got += int(_POP[block[:byte]].sum()) + (int(_POP[block[byte] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)
        return got

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit: its block by the rank directory, then its place there."""
        before = self._ranks[level] if bit else np.minimum(np.arange(self._per + 1) * (8 * BLOCK), self.n) - self._ranks[level]
        b = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(level, b), bitorder="little")
        return 8 * BLOCK * b + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _span(self, symbol: int, upto: int) -> tuple[int, int]:
        start, end = 0, upto
        if symbol >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.levels - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol before position i."""
        start, end = self._span(symbol, i)
        return end - start

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        start, end = self._span(symbol, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, symbol: int) -> Iterator[int]:
        return (self.select(symbol, k) for k in range(self.count(symbol)))

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions undone from the last plane to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            raw = b"".join(self._unpack.decompress(self._image[self._from[k] : self._from[k + 1]]) for k in range(level * self._per, (level + 1) * self._per))
            one = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").astype(bool)
            up, z = np.empty(self.n, kind), self.zeros[level]
            up[~one] = now[:z]
            up[one] = now[z:] | kind(1 << (self.levels - 1 - level))
            now = up
        return now


def encode_shards(docs: DataFrame, vocabulary: str, end_id: int, partitions: int | None = None, shard: int = SHARD) -> DataFrame:
    """(part, seq, n_tokens, image): shards of the documents in ascending doc_id order.

    Documents are range-partitioned by id and, within an id, by a hash of the text, so a
    repeated id spreads; null ids come first, null texts are empty.  Texts move once and
    are tokenised behind the shuffle; a task holds one open shard.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file, not data

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = bpe(shared.value), TaskContext.get().partitionId()
        open_ids, docs_in, lens, total, seq = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            image = build(np.concatenate(open_ids), docs_in, lens)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, ids in encode(batch.column(1)):
                open_ids += [ids, np.array([end_id], np.uint32)]
                docs_in.append(keys[row])
                lens.append(len(ids) + 1)
                total += len(ids) + 1
                if total >= shard:
                    yield closed()
                    open_ids, docs_in, lens, total, seq = [], [], [], 0, seq + 1
        if docs_in:
            yield closed()
        pa.default_memory_pool().release_unused()  # a worker outlives its task, and would keep the room of its batches

    return rows.mapInArrow(images, "part int, seq long, n_tokens long, image binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents out of written shards: doc_id, start, n_tokens, ids_crc32, part, seq."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(i) for i in range(3)), strict=True):
                w = WaveletMatrix(image.as_py())
                raw, ends = w.decode().astype("<u4").tobytes(), np.cumsum(w.lengths)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), w.lengths.tolist(), strict=True)]
                m = len(crc)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(w.doc_ids, pa.int64()), "_local": pa.array(ends - w.lengths), "n_tokens": pa.array(w.lengths),
                    "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part.as_py()] * m, pa.int32()), "seq": pa.array([seq.as_py()] * m, pa.int64()),
                })
        pa.default_memory_pool().release_unused()

    read = shards.select("part", "seq", "image").mapInArrow(rows, "doc_id long, _local long, n_tokens long, ids_crc32 long, part int, seq long")
    # Starts of shards: within a part, then over the parts, whose number is the partition count.
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_all")).select("part", F.coalesce(F.sum("_all").over(all_parts), F.lit(0)).alias("_before"))
    starts = sizes.withColumn("_in", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("_before") + F.col("_in")).alias("_start"))
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the shards to the shared folder (one image a row, through Spark's committer) and read them back."""
    return read_shards(written(encode_shards(docs, vocabulary, end_id), "wavelet-shards"))


