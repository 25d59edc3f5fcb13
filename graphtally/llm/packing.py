"""Sequence packing: shortest pack first over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import bpe
from .common import written

#: Equal lengths are ranked in so many hashed runs, so a length that a third of all pieces share is no single group.
RUNS = 1024


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, lengths in a pack): every piece of the histogram lies in one pack.

    Lengths go longest first, each into the packs filled least; a group of equal packs
    is split when only some take the piece.  Work depends on ``size``, not on counts.
    """
    groups: dict[int, list[list]] = {}
    fills: list[int] = []

    def put(fill: int, n: int, pattern: tuple[int, ...]) -> None:
        if fill not in groups:
            groups[fill] = []
            heapq.heappush(fills, fill)
        groups[fill].append([n, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while fills and not groups[fills[0]]:
                del groups[heapq.heappop(fills)]
            if not fills or fills[0] + length > size:
                put(length, left, (length,))
                break
            fill = fills[0]
            n, pattern = groups[fill][-1]
            taken = min(n, left)
            if taken == n:
                groups[fill].pop()
            else:
                groups[fill][-1][0] -= taken
            left -= taken
            put(fill + length, taken, (*pattern, length))
    return [(n, pattern) for some in groups.values() for n, pattern in some]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank.

    The pieces of a length take the places that the patterns hold for it in rank order:
    rank r lies in the last row of its length with first rank <= r, r minus that rank
    sequences after the row's first.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): documents with their end id, cut at multiples of ``size``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, not data

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(shared.value)
        for batch in batches:
            keys, out, held = batch.column(0).to_pylist(), [], []
            for row, ids in encode(batch.column(1)):
                n = len(ids) + 1
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                for start in range(0, n, size):
                    piece = raw[4 * start : 4 * (start + size)]
                    out.append((keys[row], start, len(piece) // 4, zlib.crc32(piece), n))
                    if keep_ids:
                        held.append(piece)
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(5)] + ([pa.array(held, pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the columns of ``pieces``, sequence_id and offset.

    Null text is empty (its end id alone is a piece); repeated rows are pieces of their
    own; an empty table gives no rows; other columns are ignored.  ``keep_ids`` adds the
    ids themselves (little-endian, 32 bits).  The histogram has at most ``size`` rows and
    alone comes to the driver; the table of places follows from it.
    """
    held = written(pieces(docs, vocabulary, end_id, size, keep_ids), "pieces")
    histogram = {r[0]: r[1] for r in held.groupBy("length").count().collect()}
    table = slots(shortest_pack_first(histogram, size))
    run = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RUNS)).cast("int")
    held = held.withColumn("_run", run)
    before = Window.partitionBy("length").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("length", "_run").agg(F.count(F.lit(1)).alias("_n")).select("length", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("length", "_run").orderBy(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")
    ranked = held.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["length", "_run"]).withColumn("rank", F.col("_from") + F.col("_in"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the sequence size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0] << 40 | t[:, 1] if len(t) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            new = [pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + new, [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)
