"""Repeated passages: windows of ``size`` tokens that occur twice, by depth-limited most-significant-digit passes.

Sorting every suffix by its first ``size`` tokens, one digit at a time, and dropping
groups of one after each digit leaves groups that are exactly the repeated windows.
Suffixes that start next to each other share nearly all of their tokens, so they are
carried together.  Every window belongs to its anchor, the position of its least gram
(equal windows choose equal anchors at equal offsets), and the order in which a window's
tokens are compared starts there:

* digit 1 is the anchor's gram, one digit for all windows of the anchor.  Classes of one
  are dropped: all those suffixes are unique.
* the digit after that is everything that any of the anchor's windows holds (the extent).
  Where a whole extent occurs twice, all its windows do, and they are settled at once.
* what is left is open: some windows repeat, others don't.  The members of a class go to
  one task with their tokens around the anchor, and there each further digit is one
  token, outwards from the gram: the class of a window after a token is the class before
  and that token, through all ``size`` tokens.  The passes are not made one by one there:
  a class name is a hash of the tokens so far, so the last one alone is computed and sorted.
* a class of more than ``gather`` members is not gathered.  Its windows are cut into
  ranges whose shared tokens make the next, longer digit, counted by key in a shuffle
  like digit 1, down to single windows; sub-classes that are small enough by then are
  gathered as above.

So a class is only ever counted, or gathered below a bound, and no position outside a
repeated digit travels.  A digit is told by 64 or 128 bits of a hash that isn't linear
in the tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import _BLANK
from .common import drop_written, release, text_of, written
from .hashing import mixed, span_hashes
from .shingles import buffers, groups

#: Tokens worked on at once.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Repeats:
    """``unit`` is ``bytes`` or ``words`` (between ASCII blanks)."""

    size: int = 400
    unit: str = "bytes"
    #: Tokens of an anchor's gram; size - gram + 1 windows may hold an anchor.
    gram: int = 145
    #: Members of a class that one task sorts; larger classes take another digit in a shuffle first.
    gather: int = 4096

    @property
    def width(self) -> int:
        return self.size - self.gram + 1

    @property
    def steps(self) -> tuple[int, ...]:
        """Windows in a range at each pass over large classes: a quarter of the pass before, down to one."""
        out = [self.width]
        while out[-1] > 1:
            out.append(-(-out[-1] // 4))
        return tuple(out)


def tokens_of(b: np.ndarray, own: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, edges of the texts in tokens, start and end byte of each token); a word is its hash."""
    if p.unit == "bytes":
        at = np.arange(len(b))
        return b, own, at, at + 1
    n = len(b)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_BLANK[b]
    edge = np.zeros(n + 1, bool)
    edge[own] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return span_hashes(b, start, end), np.searchsorted(start, own), start, end


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Least key of every run of w."""
    n = len(key) - w + 1
    room = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    room[: len(key)] = key
    block = room.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


#: An odd multiplier and its inverse modulo 2**64, whose powers weigh the tokens of a gram.
_BASE = 0x9FB21C651E98DF25
_VALUE = mixed(np.arange(256, dtype=np.uint64) + np.uint64(31))
_powers: list[np.ndarray] = []


def _grams(part: np.ndarray, gram: int) -> np.ndarray:
    """A number for each gram that only ranks it: two grams that share one are told apart later."""
    if not _powers:
        with np.errstate(over="ignore"):
            n = AT_ONCE + (1 << 16)
            _powers.extend(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x % 2**64, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 2**64)))
    up, down = _powers
    with np.errstate(over="ignore"):
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_VALUE[part] if part.dtype == np.uint8 else mixed(part)) * up[: len(part)], out=total[1:])
        return mixed((total[gram:] - total[:-gram]) * down[: len(part) - gram + 1])


def anchors(tokens: np.ndarray, edges: np.ndarray, p: Repeats) -> np.ndarray:
    """Positions of the least gram of every window that lies in one text; leftmost of equals."""
    found = []
    for low in range(0, max(1, len(tokens)), AT_ONCE):  # windows that start in low..low+AT_ONCE-1
        part = tokens[low : low + AT_ONCE + p.size - 1]
        if len(part) < p.size:
            break
        start = np.arange(len(part) - p.size + 1)
        right = edges[np.minimum(np.searchsorted(edges, start + low, "right"), len(edges) - 1)]
        inside = start + low + p.size <= right
        if not inside.any():
            continue
        gram = _grams(part, p.gram)
        key = (gram & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(gram), dtype=np.uint64)
        chosen = np.zeros(len(gram), bool)
        chosen[(_least(key, p.width)[inside] & np.uint64(0x3FFFFF)).astype(np.int64)] = True
        found.append(np.flatnonzero(chosen) + low)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def digits(tokens: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """For anchors ``at`` in texts left..right and their windows that start first..last before the anchor: the digits.

    The shared tokens of all the windows as 64 bits, and (n, 2) of their extent.  The range
    belongs to both, the part of the extent that lies outside the text to the extent.
    """
    unit = tokens.dtype.itemsize
    raw = memoryview(np.ascontiguousarray(tokens)).cast("B")
    begin, stop = np.maximum(left, at - last), np.minimum(right, at - first + p.size)
    tag = first * 65536 + last
    cut = tag + ((begin - (at - last)) << 48) + (((at - first + p.size) - stop) << 32)
    core = [xxhash.xxh3_64_intdigest(raw[a:b], t) for a, b, t in zip(((at - first) * unit).tolist(), ((at - last + p.size) * unit).tolist(), tag.tolist(), strict=True)]
    whole = b"".join([xxhash.xxh3_128_digest(raw[a:b], t) for a, b, t in zip((begin * unit).tolist(), (stop * unit).tolist(), (cut & 0x7FFFFFFFFFFFFFFF).tolist(), strict=True)])
    return np.array(core, np.uint64), np.frombuffer(whole, "<u8").reshape(-1, 2)


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _lists(edges: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)


def _first_digits(docs: DataFrame, p: Repeats) -> DataFrame:
    """h, text (packed), at, c, o, q of every text that holds a window: its anchors in order, with their first digit and extent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            for row, upto in groups(offsets, AT_ONCE):
                tokens, edges, _, _ = tokens_of(data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row], p)
                at = anchors(tokens, edges, p)
                doc = np.searchsorted(edges, at, "right") - 1
                zero = np.zeros_like(at)
                c, o = digits(tokens, edges[doc], edges[doc + 1], at, zero, zero + p.width - 1, p)
                some = np.unique(doc)
                start = np.append(np.searchsorted(doc, some), len(doc))
                packed = [pack.compress(data[offsets[row + i] : offsets[row + i + 1]].tobytes()) for i in some]
                lists = [pa.array((at - edges[doc]).astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (c, o[:, 0], o[:, 1]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + some)), pa.array(packed, pa.binary()), *(_lists(start, x) for x in lists)], ["h", "text", "at", "c", "o", "q"])

    long_enough = F.octet_length("text") >= (p.size if p.unit == "bytes" else 2 * p.size - 1)
    return docs.select(text_key(text_of()).alias("h"), text_of().alias("text")).where(long_enough).mapInArrow(rows, "h binary, text binary, at array<int>, c array<long>, o array<long>, q array<long>")


_EXTENT = ["c", "o", "q"]


def _classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled: tid, at, first; open: c, m, tid, at, first, ask) of records tid, at, first, c, o, q, ask.

    ``ask``: the record's windows are open (else it only stands for windows that are known
    to repeat).  An extent that occurs twice is settled, and stands once for those that
    are not; m is the number of extents in the class of the digit.
    """
    spark = records.sparkSession
    n = F.count(F.lit(1)) + F.sum((~F.col("ask")).cast("int"))  # what is known to repeat has two occurrences
    classes = written(records.groupBy(*_EXTENT).agg((n >= 2).alias("twice"), F.max("ask").alias("ask"), F.min(F.struct("tid", "at", "first")).alias("one")), "classes")
    asks = F.col("ask") & ~F.col("twice")
    counted = classes.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.max(asks).alias("asks")).where("m >= 2 and asks").select("c", "m")
    # Joins of two plain tables: a digit that very many share is split over tasks.
    counted = written(counted, "open-digits")
    twice = written(classes.where("twice and ask").select(*_EXTENT), "twice")
    settled = written(records.where("ask").join(twice, _EXTENT, "left_semi").select("tid", "at", "first"), "settled")
    items = written(classes.join(counted, "c").select("c", "m", "one.*", asks.alias("ask")), "items")
    for df in (classes, counted, twice):
        drop_written(spark, df)
    return settled, items


def _by_text(items: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    each = items.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("items"))  # a text's own anchors
    return texts.select("tid", "text").join(each, "tid")


def _opened(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[tuple[int, np.ndarray, pa.StructArray]]:
    """(tid, tokens, items) of each row (tid, text, items)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            b = np.frombuffer(unpack.decompress(batch.column(1)[i].as_py(), max_output_size=1 << 31), np.uint8)
            yield batch.column(0)[i].as_py(), tokens_of(b, np.array([0, len(b)]), p)[0], batch.column(2)[i].values


def _ints(items: pa.StructArray, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)


def _contexts(joined: DataFrame, p: Repeats, wide: int) -> DataFrame:
    """c, tid, at, first, lead, ask, context: the tokens of an item's extent; ``lead`` of them lie outside the text on the left."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tid, tokens, items in _opened(batches, p):
            at, first = _ints(items, "at", "first")
            last = np.minimum(first + wide, p.width) - 1
            begin, stop = np.maximum(0, at - last), np.minimum(len(tokens), at - first + p.size)
            raw, unit = memoryview(np.ascontiguousarray(tokens)).cast("B"), tokens.dtype.itemsize
            context = [bytes(raw[a:b]) for a, b in zip((begin * unit).tolist(), (stop * unit).tolist(), strict=True)]
            columns = [items.field("c"), pa.array(np.full(len(at), tid)), items.field("at"), items.field("first"), pa.array((begin - at + last).astype(np.int32)), items.field("ask"), pa.array(context, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["c", "tid", "at", "first", "lead", "ask", "context"])

    return joined.mapInArrow(rows, "c long, tid long, at int, first int, lead int, ask boolean, context binary")


def repeated_windows(group: np.ndarray, first: np.ndarray, lead: np.ndarray, contexts: list[np.ndarray], wide: int, p: Repeats) -> np.ndarray:
    """(n, wide): whether window s of each item equals the same window of another item of its group.

    Items of a group share the gram that all windows hold.  Column s is the window that
    starts s tokens into the item's extent.
    """
    n, span = len(group), wide - 1 + p.size
    room = np.zeros((n, span), contexts[0].dtype if n else np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, n)
    for i, x in enumerate(contexts):
        room[i, lead[i] : lead[i] + size[i]] = x
    steps = np.arange(wide)
    valid = (steps >= lead[:, None]) & (steps + p.size <= (lead + size)[:, None]) & (steps < (np.minimum(first + wide, p.width) - first)[:, None])
    # Digits outwards from the gram, a token each: the class after a token is the class before and that token.
    spread, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    ahead, behind = np.empty((wide, n), np.uint64), np.empty((wide, n), np.uint64)
    with np.errstate(over="ignore"):
        ahead[0] = behind[wide - 1] = mixed(group.astype(np.uint64) * spread + np.uint64(1))
        for s in range(1, wide):
            ahead[s] = mixed(ahead[s - 1] * odd + room[:, p.size + s - 1].astype(np.uint64))
            behind[wide - 1 - s] = mixed(behind[wide - s] * odd + room[:, wide - 1 - s].astype(np.uint64))
        name = mixed(ahead + mixed(behind + (steps.astype(np.uint64) * spread)[:, None]))
    out = np.zeros((wide, n), bool)
    at = np.flatnonzero(valid.T.ravel())
    order = at[np.argsort(name.ravel()[at])]
    a, b = order[:-1], order[1:]
    same = (name.ravel()[a] == name.ravel()[b]) & (ahead.ravel()[a] == ahead.ravel()[b]) & (behind.ravel()[a] == behind.ravel()[b]) & (a // max(n, 1) == b // max(n, 1))
    flat = out.ravel()
    flat[a[same]] = flat[b[same]] = True
    return flat.reshape(wide, n).T


def _gathered(contexts: DataFrame, p: Repeats, wide: int) -> DataFrame:
    """(tid, start, stop) of the repeated windows of open items, whole classes at a time; rows ascend by c."""
    kind = np.uint8 if p.unit == "bytes" else np.uint64

    def settle(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        c, tid, at, first, lead = (table.column(x).to_numpy().astype(np.int64) for x in ("c", "tid", "at", "first", "lead"))
        ask = np.asarray(table.column("ask").to_pylist(), bool)
        group = np.cumsum(np.concatenate(([0], c[1:] != c[:-1])))
        twice = repeated_windows(group, first, lead, [np.frombuffer(x.as_py(), kind) for x in table.column("context")], wide, p)
        twice &= ask[:, None]
        edge = np.diff(np.pad(twice.view(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)  # runs in the same order
        zero = at - np.minimum(first + wide, p.width) + 1
        return pa.RecordBatch.from_pydict({"tid": pa.array(tid[row]), "start": pa.array(zero[row] + start), "stop": pa.array(zero[row] + stop - 1 + p.size)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                if not part.num_rows:
                    continue
                held.append(part)
                c = part.column(0).to_numpy()
                new = np.flatnonzero(c[1:] != c[:-1])
                if len(new):  # up to the last class that ends here
                    cut = int(new[-1]) + 1
                    yield settle(pa.Table.from_batches([*held[:-1], part.slice(0, cut)]))
                    held = [part.slice(cut)]
        if held:
            yield settle(pa.Table.from_batches(held))

    return contexts.repartition(F.col("c")).sortWithinPartitions("c").mapInArrow(rows, "tid long, start long, stop long")


def _next_digits(joined: DataFrame, step: int, p: Repeats) -> DataFrame:
    """The records of each item's smaller ranges."""
    before, now = p.steps[step - 1], p.steps[step]
    names = ["tid", "at", "first", "c", "o", "q", "ask"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tid, tokens, items in _opened(batches, p):
            at, first, ask = _ints(items, "at", "first", "ask")
            k = -(-before // now)
            shift = np.tile(np.arange(k) * now, len(at))
            at, low, ask = (np.repeat(x, k) for x in (at, first, ask))
            start = low + shift
            last = np.minimum(start + now, np.minimum(low + before, p.width)) - 1
            fits = (start <= last) & (np.maximum(start, at + p.size - len(tokens)) <= np.minimum(last, at))
            at, start, last, ask = (x[fits] for x in (at, start, last, ask))
            c, o = digits(tokens, np.zeros_like(at), np.full_like(at, len(tokens)), at, start, last, p)
            longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (c, o[:, 0], o[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tid)), pa.array(at.astype(np.int32)), pa.array(start.astype(np.int32)), *longs, pa.array(ask.astype(bool))], names)

    return joined.mapInArrow(rows, "tid long, at int, first int, c long, o long, q long, ask boolean")


def repeated_spans(docs: DataFrame, p: Repeats = Repeats()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(texts: tid, h, copies, text; spans: tid, start, stop): tokens covered by repeated windows, by text.

    ``h`` is the key of a text (``text_key``), ``text`` its packed bytes, for texts that
    hold a window; start and stop count tokens and may reach beyond the text's.  Copies of
    a text are one text here, all of whose windows repeat.
    """
    spark = docs.sparkSession
    held = ["text", "at", "c", "o", "q"]
    texts = _first_digits(docs, p).groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct(*held)).alias("x"))
    texts = written(texts.select(F.monotonically_increasing_id().alias("tid"), "h", "copies", *[f"x.{c}" for c in held]), "texts")
    release(spark)
    shared = written(texts.select(F.explode("c").alias("c")).groupBy("c").count().where("count > 1").select("c"), "shared")
    every = texts.select("tid", (F.col("copies") == 1).alias("ask"), F.inline(F.arrays_zip("at", "c", "o", "q"))).select("tid", "at", F.lit(0).alias("first"), "c", "o", "q", "ask")
    records = written(every.join(shared, "c", "left_semi").select("tid", "at", "first", "c", "o", "q", "ask"), "records")
    drop_written(spark, shared)
    found = [texts.where("copies > 1").select("tid", F.lit(0).cast("long").alias("start"), F.lit((1 << 62) - 1).alias("stop"))]
    for step, wide in enumerate(p.steps):
        release(spark)
        settled, items = _classes(records)
        drop_written(spark, records)
        release(spark)
        last = F.least(F.col("first") + F.lit(wide), F.lit(p.width)) - 1
        found.append(settled.select("tid", (F.col("at") - last).cast("long").alias("start"), (F.col("at") - F.col("first") + p.size).cast("long").alias("stop")))
        if wide == 1:
            drop_written(spark, items)
            break
        small = items.where(F.col("m") <= p.gather)
        found.append(written(_gathered(_contexts(_by_text(small, texts, ["c", "at", "first", "ask"]), p, wide), p, wide), "spans"))
        large = written(items.where(F.col("m") > p.gather).drop("c", "m"), "large")
        drop_written(spark, items)
        release(spark)
        if large.isEmpty():
            break
        records = written(_next_digits(_by_text(large, texts, ["at", "first", "ask"]), step + 1, p), "records")
        drop_written(spark, large)
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionAll(x)
    return texts.select("tid", "h", "copies", "text"), spans


def _cleaned(joined: DataFrame, p: Repeats) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                b = np.frombuffer(unpack.decompress(batch.column(1)[i].as_py(), max_output_size=1 << 31), np.uint8)
                _, _, begin, end = tokens_of(b, np.array([0, len(b)]), p)
                start, stop = _ints(batch.column(2)[i].values, "start", "stop")
                start, stop = np.maximum(start, 0), np.minimum(stop, len(begin))
                change = np.zeros(len(b) + 1, np.int32)
                np.add.at(change, begin[start], 1)
                np.add.at(change, end[stop - 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                left = b[~gone].tobytes()
                out.append((batch.column(0)[i].as_py(), int(gone.sum()), len(edge) // 2, hashlib.sha256(left).hexdigest(), left, edge.reshape(-1, 2).tolist()))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["h", "n_removed", "n_spans", "kept_sha256", "left", "spans"])

    return joined.select("h", "text", "gaps").mapInArrow(rows, "h binary, n_removed long, n_spans long, kept_sha256 string, left binary, spans array<array<long>>")


def cut_texts(docs: DataFrame, p: Repeats = Repeats(), *columns: str | Column) -> DataFrame:  # noqa: B008
    """h, n_removed, n_spans, kept_sha256, left, spans (bytes) of every text that loses something, or ``columns`` of these, as a written table."""
    spark = docs.sparkSession
    texts, spans = repeated_spans(docs, p)
    each = spans.groupBy("tid").agg(F.collect_set(F.struct("start", "stop")).alias("gaps"))  # a text's own spans
    cut = written(_cleaned(texts.select("tid", "h", "text").join(each, "tid"), p).select(*(columns or ["*"])), "cuts")
    drop_written(spark, texts)
    drop_written(spark, spans)
    release(spark)
    return cut


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), passages: Repeats | None = None) -> DataFrame:  # noqa: B008
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    Every byte in a window that also starts elsewhere goes, each occurrence included;
    ``text`` is what stays (a character of which a part was cut shows as a replacement
    mark there, ``kept_sha256`` is of the bytes).  Null text is empty; a repeated row
    repeats its text and so loses all of it when it is long enough.  Other columns are
    ignored.

    ``passages`` is a second measure (50 words, say, may be fewer bytes than ``p`` asks
    for, or differ in their blanks) that is counted only: n_passages and n_passage_bytes
    follow, what would go by it.
    """
    counts = ["n_passages", "n_passage_bytes"] if passages else []
    if passages:
        by_it = cut_texts(docs, passages, "h", F.col("n_spans").alias(counts[0]), F.col("n_removed").alias(counts[1]))
    cut = cut_texts(docs, p).select("h", "n_removed", "n_spans", F.col("kept_sha256").alias("cut_sha"), "left")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of(), 256).alias("whole_sha"), text_of().alias("whole"))
    rows = rows.withColumn("h", F.substring(F.unhex("whole_sha"), 1, 16)).join(cut, "h", "left")
    if passages:
        rows = rows.join(by_it, "h", "left")
    none = F.lit(0).cast("long")
    left = F.coalesce(F.make_valid_utf8(F.col("left").cast("string")), F.col("whole"))
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("cut_sha", "whole_sha").alias("kept_sha256"), left.alias("text"), *[F.coalesce(c, none).alias(c) for c in counts])


def without_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:  # noqa: B008
    """The documents without their repeated passages; columns of ``docs``, ``n_chars`` counted anew.

    Documents of which nothing but blanks is left go.
    """
    cut = cut_texts(docs, p).select("h", F.make_valid_utf8(F.col("left").cast("string")).alias("left"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = docs.select(row, text_key(text_of()).alias("h")).join(cut, "h", "left").where(F.col("left").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    out = {"text": F.coalesce("left", "row.text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.length("left").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return df.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`") for c in docs.columns])
