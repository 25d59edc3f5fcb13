"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

Texts with one shingle set are one node from the start.  Nodes that agree in a band are
candidates.  Every node first meets one pivot of its buckets, links contract into
components, and further pivots look only at members outside the pivot's component.
What buckets still hold in several components is compared in full, small buckets pair
by pair and large ones block against block on signatures, so no candidate is lost.  A pair's signatures are compared batch by batch, and the pair is dropped once
the posterior probability of its similarity reaching the threshold falls under ``miss``;
whatever survives is decided on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, only, release, written
from .components import components
from .shingles import buffers, shingle_sets


@dataclass(frozen=True)
class Near:
    words: int = 5
    #: Linked from this percentage of shared shingles on.
    percent: int = 80
    #: A pair at 80 % misses all bands with probability (1 - 0.8**rows)**bands = 1.3e-7.
    rows: int = 5
    bands: int = 40
    #: Hashes compared at a time, and the posterior probability under which a pair is dropped.
    batch: int = 20
    miss: float = 1e-7
    seed: int = 7
    #: Buckets up to this size are compared pair by pair, larger ones by pivots.
    small: int = 8
    #: Pivot rounds after the first.
    rounds: int = 1
    #: Rows of a block in what is compared block by block.
    block: int = 1024
    #: Shingles of such a block; a longer text is a block's own.
    weight: int = 1 << 20


def least_matches(p: Near) -> list[tuple[int, int]]:
    """(hashes seen, matches needed to go on) after each batch.

    With a uniform prior the posterior of the similarity after m matches in n is
    Beta(m+1, n-m+1), and P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out, t = [], p.percent / 100
    for n in range(p.batch, p.rows * p.bands + 1, p.batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= p.miss:
                break
            m += 1
        out.append((n, m))
    return out


def _constants(p: Near) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(p.seed)
    n = p.rows * p.bands
    return r.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(docs: DataFrame, p: Near, row: str = "") -> DataFrame:
    """doc_id, n, fp (of the shingle set), keys (one per band), sig (16 bits a hash), text (packed); and ``row``, a long column of ``docs``, where one is named."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants(p)
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            for at, edges, h in shingle_sets(batch.column(1), p.words):
                m, some = len(edges) - 1, np.flatnonzero(np.diff(edges))
                sig = np.zeros((m, len(a)), np.uint32)
                if len(some):
                    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
                    for i in range(len(a)):
                        sig[some, i] = np.minimum.reduceat(low * a[i] + high * b[i], edges[:-1][some])
                wide = sig.reshape(m, p.bands, p.rows).astype(np.uint64)
                keys = np.broadcast_to(np.arange(p.bands, dtype=np.uint64) + np.uint64(1), (m, p.bands)).copy()
                with np.errstate(over="ignore"):
                    for j in range(p.rows):
                        keys = (keys ^ (wide[:, :, j] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                        keys ^= keys >> np.uint64(29)
                short = (sig >> np.uint32(16)).astype("<u2") ^ (sig & np.uint32(0xFFFF)).astype("<u2")
                fps = [hashlib.blake2b(h[edges[i] : edges[i + 1]].tobytes(), digest_size=16).digest() for i in range(m)]
                texts = [pack.compress(data[offsets[at + i] : offsets[at + i + 1]].tobytes()) for i in range(m)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, m), "n": pa.array(np.diff(edges).astype(np.int64)), "fp": pa.array(fps, pa.binary()),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * p.bands), pa.array(keys.view(np.int64).ravel())),
                    "sig": pa.array([s.tobytes() for s in short], pa.binary()), "text": pa.array(texts, pa.binary()),
                } | ({row: batch.column(2).slice(at, m)} if row else {}))

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[row] * bool(row))
    return asked.mapInArrow(rows, "doc_id long, n long, fp binary, keys array<long>, sig binary, text binary" + f", `{row}` long" * bool(row))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<u2").reshape(-1, n)


def _prune(pairs: DataFrame, p: Near) -> DataFrame:
    """(a, b) of (a, b, sig_a, sig_b) that may reach the threshold."""
    steps = least_matches(p)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(i), p.rows * p.bands) for i in (2, 3))
            left, met, seen = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in steps:
                met = met + (x[left, seen:n] == y[left, seen:n]).sum(1)
                keep = met >= least
                left, met, seen = left[keep], met[keep], n
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(left)) for i in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(rows, "a long, b long")


def _confirm(pairs: DataFrame, p: Near) -> DataFrame:
    """Links (u, v) among (a, b, text_a, text_b), by the full shingle sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                raw: dict[int, bytes] = {}
                for ids, texts in ((0, 2), (1, 3)):
                    for k, t in zip(batch.column(ids).to_pylist(), batch.column(texts), strict=True):
                        if k not in raw:
                            raw[k] = t.as_py()
                names = list(raw)
                sets: dict[int, np.ndarray] = {}
                for row, edges, h in shingle_sets(pa.array([unpack.decompress(raw[k], max_output_size=1 << 31).decode() for k in names], pa.large_string()), p.words):
                    for j in range(len(edges) - 1):
                        sets[names[row + j]] = h[edges[j] : edges[j + 1]]
                found = []
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x, y = sets[a], sets[b]
                    if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
                        continue
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    if 100 * shared >= p.percent * (len(x) + len(y) - shared):
                        found.append((a, b))
                yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return pairs.mapInArrow(rows, "u long, v long")


def _verified(pairs: DataFrame, nodes: DataFrame, p: Near, once: bool = False) -> DataFrame:
    """Links among candidate pairs (a, b), written; ``once``: hardly a pair comes twice."""
    pairs = pairs.where("a <> b")
    if not once:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sig = nodes.select("nid", "sig")
    pairs = pairs.join(sig.select(F.col("nid").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("nid").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = written(_prune(pairs.select("a", "b", "sig_a", "sig_b"), p), "pairs")
    text = nodes.select("nid", "text")
    both = pairs.join(text.select(F.col("nid").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("nid").alias("b"), F.col("text").alias("text_b")), "b")
    links = written(_confirm(both.select("a", "b", "text_a", "text_b"), p), "links")
    drop_written(nodes.sparkSession, pairs)
    return links


def _overlaps(sets: list[np.ndarray], pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, shared shingles with each) for every (i, others) asked, on the full sets."""
    _, names = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    own = np.split(names, ends[:-1])
    mark = np.zeros(names.max() + 1, bool)
    for i, others in pairs:
        mark[own[i]] = True
        starts = np.concatenate(([0], np.cumsum([len(own[o]) for o in others])[:-1]))
        yield i, others, np.add.reduceat(mark[np.concatenate([own[o] for o in others])], starts, dtype=np.int64)
        mark[own[i]] = False


def _blocked(rows: DataFrame, nodes: DataFrame, p: Near) -> DataFrame:
    """Links (u, v) between different components in large buckets: (key, nid, comp, n) compared block by block.

    Members of the pivot's component meet the others only, the others each other.  A task
    holds two blocks, bounded by rows and by shingles.  It prunes on sizes and signatures,
    leaves a pair to the first band that it shares, decides what survives on the full
    sets and returns one link for each two components that it joins, never the pairs.
    """
    steps = least_matches(p)
    own = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min(F.xxhash64("nid")).alias("h"))
    head = F.min_by(F.struct("comp", "rows", "n"), "h")
    plan = own.groupBy("key").agg(head.alias("x"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))

    def blocks(count: Column, n: Column) -> Column:
        return F.ceil(F.greatest(count / p.block, n / p.weight)).cast("int")

    inside = blocks(F.col("x.rows"), F.col("x.n")).alias("ni")
    outside = blocks(F.col("rows") - F.col("x.rows"), F.col("n") - F.col("x.n")).alias("no")
    # Written first: a join of two plain tables splits a bucket that very many share.
    plan = written(plan.select("key", F.col("x.comp").alias("head"), inside, outside), "buckets")
    rows = rows.join(plan, "key").withColumn("inner", F.col("comp") == F.col("head")).withColumn("h", F.xxhash64("nid"))
    own = F.pmod("h", F.greatest(F.when(F.col("inner"), F.col("ni")).otherwise(F.col("no")), F.lit(1))).cast("int")
    rows = rows.withColumn("own", own)

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    inner = rows.where("inner").withColumn("r", upto("no")).select("key", "nid", "comp", "r", F.lit(0).alias("kind"), F.col("own").alias("s"), F.lit(1).alias("side"))
    outer = rows.where("not inner")
    left = outer.withColumn("s", upto("ni")).select("key", "nid", "comp", F.col("own").alias("r"), F.lit(0).alias("kind"), "s", F.lit(0).alias("side"))
    each = outer.withColumn("t", upto("no")).select("key", "nid", "comp", F.least("own", "t").alias("r"), F.lit(1).alias("kind"), F.greatest("own", "t").alias("s"), (F.col("own") > F.col("t")).cast("int").alias("side"))
    # The same join at every size: what is compared grows with the buckets.
    tasks = inner.unionAll(left).unionAll(each).join(nodes.select("nid", "n", "keys", "sig", "text").hint("merge"), "nid")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, nid, n = (table.column(c).to_numpy() for c in ("side", "nid", "n"))
        comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        sig = _matrix(table.column("sig"), p.rows * p.bands)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, p.bands)
        band = int(np.argmax(keys[0] == table.column("key")[0].as_py()))
        same = table.column("kind")[0].as_py() == 1 and table.column("r")[0].as_py() == table.column("s")[0].as_py()
        lefts = np.flatnonzero(side == 0)
        rights = lefts if same else np.flatnonzero(side == 1)
        asked: list[tuple[int, np.ndarray]] = []
        for i in lefts:
            other = rights[rights > i] if same else rights
            other = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= p.percent * np.maximum(n[other], n[i]))]
            met, seen = np.zeros(len(other), np.int64), 0
            for m, least in steps:
                met = met + (sig[other, seen:m] == sig[i, seen:m]).sum(1)
                keep = met >= least
                other, met, seen = other[keep], met[keep], m
                if not len(other):
                    break
            other = other[~(keys[other, :band] == keys[i, :band]).any(1)]
            if len(other):
                asked.append((i, other))
        found: list[tuple[int, int]] = []
        if asked:
            unpack = zstandard.ZstdDecompressor()
            used = np.unique(np.concatenate([[i for i, _ in asked], *[o for _, o in asked]]))
            place = np.zeros(len(nid), np.int64)
            place[used] = np.arange(len(used))
            text = table.column("text").combine_chunks()
            sets: list[np.ndarray] = []
            for low in range(0, len(used), 64):
                raw = [unpack.decompress(text[int(k)].as_py(), max_output_size=1 << 31).decode() for k in used[low : low + 64]]
                for _, edges, h in shingle_sets(pa.array(raw, pa.large_string()), p.words):
                    sets += np.split(h, edges[1:-1])

            def still() -> Iterator[tuple[int, np.ndarray]]:
                for i, other in asked:
                    other = other[comp[other] != comp[i]]
                    if len(other):
                        yield place[i], place[other]

            for x, others, shared in _overlaps(sets, still()):
                i, other = used[x], used[others]
                for o in other[100 * shared >= p.percent * (n[i] + n[other] - shared)]:
                    if comp[o] != comp[i]:
                        found.append((nid[i], nid[o]))
                        comp[comp == comp[o]] = comp[i]
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    links = written(tasks.groupBy("key", "r", "kind", "s").applyInArrow(compare, "u long, v long").distinct(), "links")
    drop_written(rows.sparkSession, plan)
    return links


def _placed(docs: DataFrame, p: Near, row: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows: ``signatures``; placed: fp, nid, low, root): each shingle set with its component.

    ``low`` is the least doc_id of the set's rows, or with ``row`` the least struct of
    (whether the id is null, doc_id, row).
    """
    spark = docs.sparkSession
    rows = written(signatures(docs, p, row).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    held = rows.where("n > 0")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)) if row else F.min("doc_id")
    # A set's node bears the number of its first row, whose text and signature stand for it.
    nodes = written(held.groupBy("fp").agg(low.alias("low"), F.min("rid").alias("nid"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")

    band = nodes.select("nid", F.explode("keys").alias("key"))
    # Written first: a join of two plain tables splits a band key that very many share. The
    # keys grow with the data, so they are never broadcast, however few a small input has.
    shared = written(band.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("nid").alias("pivot")).where("cnt > 1"), "shared")
    met = written(band.join(shared.hint("merge"), "key").select("nid", "key", "cnt", "pivot"), "buckets")
    drop_written(spark, shared)
    # First every node meets one pivot: the least of its buckets' least members.
    first = written(met.groupBy("nid").agg(F.min("pivot").alias("a")), "first")
    full = held.select(F.col("rid").alias("nid"), "sig", "text").join(first.select("nid").hint("merge"), "nid", "left_semi")
    full = written(full, "candidates")
    links = _verified(first.select("a", F.col("nid").alias("b")), full, p, once=True)
    drop_written(spark, first)
    roots = components(links)
    drop_written(spark, links)

    def open_rows() -> DataFrame:
        """Rows of buckets that still hold several components."""
        r = met.join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("key", "nid", "cnt", F.coalesce("root", "nid").alias("comp"))
        left = written(r.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "open-keys")
        return r.join(left, "key", "left_semi")

    for turn in range(p.rounds + 1):
        left = written(open_rows(), "open")
        if left.isEmpty():
            break
        if turn < p.rounds:
            # A pivot per bucket; a node meets one pivot of each component that it is not in.
            order = F.xxhash64("nid", F.lit(turn))
            pivots = left.where(F.col("cnt") > p.small).groupBy("key").agg(F.min_by(F.struct(F.col("nid").alias("a"), F.col("comp").alias("of")), order).alias("x")).select("key", "x.*")
            near = left.join(pivots, "key").where("comp <> of").groupBy("nid", "of").agg(F.min("a").alias("a"))
            more = [_verified(near.select("a", F.col("nid").alias("b")), full, p, once=True)]
        else:
            member = F.struct(F.col("nid").alias("a"), F.col("comp").alias("c"))
            few = left.where(F.col("cnt") <= p.small).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("ids"))
            two = F.flatten(F.transform("ids", lambda x, i: F.transform(F.filter(F.slice("ids", i + 2, F.lit(p.small)), lambda y: y["c"] != x["c"]), lambda y: F.struct(x["a"].alias("a"), y["a"].alias("b")))))
            more = [_verified(few.select(F.explode(two).alias("x")).select("x.*"), full, p)]
            large = left.where(F.col("cnt") > p.small).join(nodes.select("nid", "n"), "nid").select("key", "nid", "comp", "n")
            if not large.isEmpty():
                more.append(_blocked(large, full.join(nodes.select("nid", "n", "keys"), "nid"), p))
        before = (*more, roots, left)
        # The components so far are stars that stand for all links so far.
        edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        for df in more:
            edges = edges.unionAll(df.select("u", "v"))
        roots = components(edges)
        for df in before:
            drop_written(spark, df)

    placed = nodes.select("fp", "nid", "low").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    placed = written(placed, "placed")
    for df in (full, met, roots, nodes):
        drop_written(spark, df)
    release(spark)
    return rows, placed


def near_duplicates(docs: DataFrame, p: Near = Near()) -> DataFrame:  # noqa: B008
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and blank texts have no shingles and link with nothing; texts of fewer words
    than a shingle are one shingle.  ``component_id`` is the least doc_id reachable
    (rows without shingles: their own), ``kept`` whether it is the row's own; rows that
    repeat the kept id are kept together, null ids count only where a component has no
    other.  Other columns are ignored.
    """
    rows, placed = _placed(docs, p)
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    out = rows.select("doc_id", "n", "fp").join(named, "fp", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "components")
    for df in (rows, placed):
        drop_written(docs.sparkSession, df)
    return out


def one_of_each(docs: DataFrame, p: Near = Near()) -> DataFrame:  # noqa: B008
    """One row of every component, the one of the least id (null ids last, then any one); columns of ``docs``.

    Components hold rows, not ids: a row stays or goes by its own number, whatever else
    bears its id.  Rows without shingles link with nothing and all stay.
    """
    numbered = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    rows, placed = _placed(numbered.select("row.doc_id", "row.text", "number"), p, "number")
    kept = placed.groupBy("root").agg(F.min("low").alias("low")).select("low.number").unionAll(rows.where("n = 0").select("number"))
    kept = written(kept, "kept")
    for df in (rows, placed):
        drop_written(docs.sparkSession, df)
    return only(numbered, kept, "number").select("row.*")
