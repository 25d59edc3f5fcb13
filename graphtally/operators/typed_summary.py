"""Typed summary graph: vertices of one type are a bucket, edges between buckets carry counts.

The estimate is the expected number of matches over graphs that share the summary:
every embedding of the pattern in the summary contributes the weight products of all
ways pattern edges can fall on one edge (inclusion and exclusion over edge partitions).
The signs of that lattice are a small table, joined to the embeddings.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.store import Store
from .base import Estimator, empty
from .graph import Graph, ranked


def buckets(types: DataFrame) -> DataFrame:
    """(bucket, w, vls, outs, ins) of (vid, vls, outs, ins): one row per vertex type; the bucket is its least vertex."""
    return types.groupBy("vls", "outs", "ins").agg(F.min("vid").alias("bucket"), F.count(F.lit(1)).alias("w"))


def membership(types: DataFrame, b: DataFrame) -> DataFrame:
    """(vid, bucket)."""
    t = ["vls", "outs", "ins"]
    return types.join(b.select(*t, "bucket"), t).select("vid", "bucket")


def summary_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(bs, el, bd, w): edges by the buckets of their ends."""
    e = edges.join(member.select(F.col("vid").alias("src"), F.col("bucket").alias("bs")), "src").join(member.select(F.col("vid").alias("dst"), F.col("bucket").alias("bd")), "dst")
    return e.groupBy("bs", "el", "bd").agg(F.count(F.lit(1)).alias("w"))


def includes(kind: str, labels: set[int]) -> F.Column:
    """Whether a label list holds all of these labels."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in sorted(labels)]).cast("array<int>"), F.col(kind))) == 0


#: Rows and columns of the signature scheme, and the bins of a row.
ROWS, COLUMNS, BINS = 40, 2, 32768


def scheme() -> np.ndarray:
    """(ROWS * COLUMNS, 2) signed 32-bit factors and terms: the raw outputs of the Mersenne Twister of seed 0."""
    raw = np.random.MT19937()
    raw._legacy_seeding(0)
    return (raw.random_raw(2 * ROWS * COLUMNS).astype(np.int64) - (1 << 31)).reshape(-1, 2)


def _wrapped(x: F.Column) -> F.Column:
    """A long as a signed 32-bit value."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def signatures(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(bucket, sig): the least hash of a bucket's incident pairs, a cell for each row and column of the scheme.

    ``edges``: (bs, el, bd) of the summary, ``ids``: (bucket, i) numbers of the buckets in
    order of their least vertex.  Pairs are (label, other end) outwards and (other end,
    label) inwards, hashed with 32-bit wrap-around.
    """
    e = edges.join(ids.select(F.col("bucket").alias("bs"), F.col("i").alias("x")), "bs").join(ids.select(F.col("bucket").alias("bd"), F.col("i").alias("y")), "bd")
    pair = F.lit(127)
    pairs = e.select(F.col("bs").alias("bucket"), (F.col("el") * pair + F.col("y")).alias("p")).unionAll(e.select(F.col("bd").alias("bucket"), (F.col("x") * pair + F.col("el")).alias("p")))
    p = _wrapped(F.col("p") * F.lit(31))
    # Products of two 32-bit values fit a long.
    cells = [F.min(_wrapped(p * F.lit(int(a)) + F.lit(int(b)))).alias(f"s{k}") for k, (a, b) in enumerate(scheme())]
    return pairs.groupBy("bucket").agg(*cells).select("bucket", F.array(*[f"s{k}" for k in range(ROWS * COLUMNS)]).alias("sig"))


def merged_in_class(i: np.ndarray, alive: np.ndarray, sig: np.ndarray, threshold: float) -> np.ndarray:
    """Which bucket each of a class's buckets falls to (its position; its own if none), after one sweep over the rows.

    In every bin of a row the first bucket takes the first other one whose signature
    agrees in the threshold's share of cells; what was taken is out of the later rows.
    """
    to, alive = np.arange(len(i)), alive.copy()
    one = sig.reshape(len(i), ROWS, COLUMNS).astype(np.int64)
    for row in range(ROWS):
        h = np.ones(len(i), np.int64)
        for c in range(COLUMNS):
            h = (31 * h + one[:, row, c] + (1 << 31)) % (1 << 32) - (1 << 31)
        bins = (h ^ ((h & 0xFFFFFFFF) >> 16)) & 0x7FFFFFFF & (BINS - 1)
        some = np.flatnonzero(alive)
        order = some[np.argsort(bins[some], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1):
            if len(part) < 2:
                continue
            same = (sig[part[1:]] == sig[part[0]]).mean(1) >= threshold
            if same.any():
                k = part[1 + int(np.argmax(same))]
                to[k], alive[k] = part[0], False
    return to


def merged_by_rows(rows: DataFrame, threshold: float, store: Store, name: str) -> DataFrame:
    """(bucket, to) of ``rows`` (vls, bucket, i, alive, sig), the same sweep as ``merged_in_class`` row by row of the scheme, for class sets of any size.

    A (class set, bin) pair is only ever counted or joined to its first bucket, never gathered.
    """
    taken = None
    for row in range(ROWS):
        h = F.lit(1)
        for c in range(COLUMNS):
            h = _wrapped(h * F.lit(31) + F.get("sig", F.lit(row * COLUMNS + c)))
        low = h.bitwiseXOR(F.shiftright(h.bitwiseAND(F.lit(0xFFFFFFFF)), 16)).bitwiseAND(F.lit(BINS - 1))
        alive = rows.where("alive").withColumn("bin", low)
        alive = alive.join(taken.select("bucket"), "bucket", "left_anti") if taken is not None else alive
        first = alive.groupBy("vls", "bin").agg(F.min_by(F.struct("bucket", "i", "sig"), "i").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        same = F.aggregate(F.zip_with("sig", "first.sig", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
        like = alive.join(first.select("vls", "bin", "first"), ["vls", "bin"]).where((F.col("i") > F.col("first.i")) & (same / F.lit(ROWS * COLUMNS) >= F.lit(threshold)))
        pairs = like.groupBy("vls", "bin").agg(F.min_by(F.struct("bucket", F.col("first.bucket").alias("to")), "i").alias("x")).select("x.bucket", "x.to")
        pairs = store.save(f"{name}-{row}", pairs)
        taken = pairs if taken is None else taken.unionAll(pairs)
    return taken


def refined(held: Store, g: Graph, ratio: float, threshold: float, least_target: float = 10000.0, gather: int = 1 << 16) -> None:
    """Merge similar buckets of one class set until the summary's edges fit the target; tables bucket, member, edge of ``held``.

    Target: (ratio * data size - 4 |V|) / 12, at least ``least_target``, sizes in bytes of
    32-bit numbers.  A sweep goes over all class sets; sweeps end at the target or when
    one saves fewer than 1000 edges, and then whole runs of class sets become one bucket
    each.  A class set of up to ``gather`` types (not vertices) is swept in one task, a
    larger one row by row of the scheme by all.
    """
    spark = g.edges.sparkSession
    v, labels = g.stats["v"], sum(g.stats["vl"].values())
    data = 4 * (v + 2 * g.stats["e"] + labels)
    target = max((ratio * data - 4 * v) / 12, least_target)
    bucket, edges = held.table("typed_bucket"), held.table("typed_edge")
    before = edges.count()
    if before <= target:
        held.save("bucket", bucket), held.save("member", held.table("typed_member")), held.save("edge", edges)
        return
    one = F.lit(0).alias("all")
    ids = held.save("numbered", ranked(bucket.select(one, "bucket", "vls"), "all", ["bucket"]).select("bucket", "vls", "i"))
    sizes = held.save("sizes", ids.groupBy("vls").agg(F.count(F.lit(1)).alias("types")).where(F.col("types") > gather))
    some_large = not sizes.isEmpty()
    mu = held.save("mu0", ids.select("bucket", F.col("bucket").alias("root")))
    turn, fits = 0, False
    while True:
        sig = signatures(edges, ids)
        rows = ids.join(mu, "bucket").join(sig, "bucket", "left")

        def sweep(table: pd.DataFrame) -> pd.DataFrame:
            table = table.sort_values("i")
            blank = [(1 << 31) - 1] * (ROWS * COLUMNS)
            cells = np.array([blank if s is None else s for s in table["sig"]], np.int64)
            to = merged_in_class(table["i"].to_numpy(), (table["bucket"] == table["root"]).to_numpy(), cells, threshold)
            own = table["bucket"].to_numpy()
            return pd.DataFrame({"bucket": own, "to": own[to]})

        if some_large:
            none = F.array_repeat(F.lit((1 << 31) - 1).cast("long"), ROWS * COLUMNS)
            large = held.save(f"signed{turn}", rows.join(sizes, "vls", "left_semi").select("vls", "bucket", F.col("i").cast("long").alias("i"), (F.col("bucket") == F.col("root")).alias("alive"), F.coalesce("sig", none).alias("sig")))
            spread = merged_by_rows(large, threshold, held, f"taken{turn}")
            rows = rows.join(sizes, "vls", "left_anti")
        step = rows.groupBy("vls").applyInPandas(sweep, "bucket long, to long")
        step = step.where("bucket <> to")
        step = held.save(f"step{turn}", step.unionAll(spread) if some_large else step)
        # A taken bucket may have been taken by one that is taken later in the sweep.
        link, hops = step.select(F.col("bucket").alias("root"), "to"), 0
        nxt = mu
        while True:
            moved = nxt.join(link, "root", "left").select("bucket", F.coalesce("to", "root").alias("root"))
            nxt = held.save(f"mu{turn + 1}-{hops}", moved)
            hops += 1
            if nxt.join(link, "root", "left_semi").isEmpty():
                break
        mu, turn = nxt, turn + 1
        at = mu.select(F.col("bucket").alias("b"), "root")
        edges = held.save(f"edges{turn}", edges.join(at.select(F.col("b").alias("bs"), F.col("root").alias("rs")), "bs").join(at.select(F.col("b").alias("bd"), F.col("root").alias("rd")), "bd").groupBy(F.col("rs").alias("bs"), "el", F.col("rd").alias("bd")).agg(F.sum("w").alias("w")))
        now = edges.count()
        fits = now <= target
        if fits or before - now < 1000:
            break
        before = now
    if not fits:
        classes = ids.join(mu.where("bucket = root"), "bucket").groupBy("vls").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("own"))
        size = classes.agg(F.sum("own"), F.sum(F.size("vls") * F.col("own"))).head()
        n = max(1, int(4 * (2 * size[0] + 3 * now + v + size[1]) / data / ratio))
        groups = ids.groupBy("vls").agg(F.min("i").alias("first"))
        groups = ranked(groups.select(one, "vls", F.col("first").cast("long").alias("first")), "all", ["first"]).withColumn("run", F.floor(F.col("i") / F.lit(n)))
        run = ids.join(groups.select("vls", "run"), "vls").select("bucket", "run")
        to = run.join(mu.where("bucket = root").select("bucket"), "bucket").groupBy("run").agg(F.min("bucket").alias("to"))
        mu = held.save("mu-last", mu.join(run.withColumnRenamed("bucket", "root"), "root").join(to, "run").select("bucket", F.col("to").alias("root")))
    parts = bucket.join(mu, "bucket")
    union = [F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("vls", "outs", "ins")]
    held.save("bucket", parts.groupBy(F.col("root").alias("b")).agg(F.sum("w").alias("w"), *union).withColumnRenamed("b", "bucket").select("vls", "outs", "ins", "bucket", "w"))
    held.save("member", held.table("typed_member").join(mu, "bucket").select("vid", F.col("root").alias("bucket")))
    at = mu.select(F.col("bucket").alias("b"), "root")
    first = held.table("typed_edge")
    held.save("edge", first.join(at.select(F.col("b").alias("bs"), F.col("root").alias("rs")), "bs").join(at.select(F.col("b").alias("bd"), F.col("root").alias("rd")), "bd").groupBy(F.col("rs").alias("bs"), "el", F.col("rd").alias("bd")).agg(F.sum("w").alias("w")))


Blocks = tuple[int, ...]


def partitions(groups: list[int]) -> list[Blocks]:
    """Set partitions of things into blocks of one group each, as block numbers in first-use order."""
    out: list[Blocks] = [()]
    for i, g in enumerate(groups):
        out = [(*x, b) for x in out for b in range(max(x, default=-1) + 2) if all(groups[j] == g for j in range(i) if x[j] == b)]
    return out


def unified(p: Pattern, blocks: Blocks) -> tuple[int, ...] | None:
    """The least vertex of each vertex's class when the edges of a block are one; None if they cannot be.

    They cannot if that makes two bound vertices one, or two blocks the same edge (another partition says so).
    """
    root, first = list(range(len(p.vertices))), {}
    for i, k in enumerate(blocks):
        e, f = p.edges[i], p.edges[first.setdefault(k, i)]
        for a, b in ((e.src, f.src), (e.dst, f.dst)):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    for v in p.vertices:
        if v.bound is not None and any(root[u.id] == root[v.id] and u.bound != v.bound for u in p.vertices):
            return None
    edges = {(root[p.edges[i].src], p.edges[i].el, root[p.edges[i].dst]) for i in first.values()}
    return tuple(root) if len(edges) == len(first) else None


def terms(p: Pattern, key: Blocks) -> dict[tuple[Blocks, Blocks], int]:
    """(powers of vertices' weights, drawn edges) -> factor: the estimate of an embedding as a sum of products.

    ``key`` names the first pattern edge on the same summary edge, for each; only those can
    be one edge.  Solutions of a partition alone are its solutions less those of all coarser
    partitions alone, filled from coarse to fine; partitions that an embedding allows are
    closed under refinement, so these signs hold for all embeddings of the key.  Products of
    equal buckets fall together, which leaves few.
    """
    like = list(range(len(p.vertices)))  # vertices that the key puts into one bucket
    for i, j in enumerate(key):
        for a, b in ((p.edges[i].src, p.edges[j].src), (p.edges[i].dst, p.edges[j].dst)):
            x, y = like[a], like[b]
            like = [min(x, y) if r in (x, y) else r for r in like]
    roots = {x: r for x in partitions(list(key)) if (r := unified(p, x)) is not None}
    alone: dict[Blocks, dict[Blocks, int]] = {}
    out: dict[tuple[Blocks, Blocks], int] = {}
    for blocks in sorted(roots, key=lambda x: max(x, default=-1)):
        root, power = roots[blocks], [0] * len(p.vertices)
        for v in set(root):
            if all(p.vertices[u].bound is None for u in range(len(root)) if root[u] == v):
                power[like[v]] += 1
        own = {tuple(power): 1}
        n = max(blocks, default=-1) + 1
        group = [key[blocks.index(b)] for b in range(n)]
        for joined in partitions(group):
            coarser = tuple(joined[b] for b in blocks)
            if coarser != blocks and coarser in roots:
                for x, k in alone[coarser].items():
                    own[x] = own.get(x, 0) - k
        alone[blocks] = own
        drawn = tuple(group.count(i) for i in range(len(p.edges)))
        for x, k in own.items():
            out[x, drawn] = out.get((x, drawn), 0) + k
    return {x: k for x, k in out.items() if k}


class TypedSummary(Estimator):
    """``ratio`` bounds the summary's size, ``threshold`` is the similarity from which buckets merge.

    Beyond ``reduce_from`` summary edges under a pattern's labels, rows without a partner are
    dropped before any are joined; the embeddings are the same.
    """

    name, fixed, whole = "sumrdf", True, True
    def __init__(self, ratio: float = 0.03, threshold: float = 0.15, least_target: float = 10000.0, gather: int = 1 << 16, reduce_from: int = 1 << 20) -> None:
        self.ratio, self.threshold, self.least_target, self.gather, self.reduce_from = ratio, threshold, least_target, gather, reduce_from

    def summarize(self, g: Graph, store: Store, patterns: Iterable[Pattern] | None = None) -> Store:
        """Tables ``bucket``, ``member`` and ``edge``, refined where the typed summary is too large."""
        types = store.save("types", g.vertex_types())
        typed = store.save("typed_bucket", buckets(types))
        member = store.save("typed_member", membership(types, typed))
        store.save("typed_edge", summary_edges(g.edges, member))
        refined(store, g, self.ratio, self.threshold, self.least_target, self.gather)
        return store

    def estimate(self, g: Graph, p: Pattern, seed: int = 0, summary: Store | None = None) -> float:
        if empty(g, p):
            return 0.0
        embeddings = self.embeddings(self.summary_of(g, summary, p), g, p).withColumn("key", self._key(p))
        if len({e.el for e in p.edges}) == len(p.edges):
            keys = [",".join(str(i) for i in range(len(p.edges)))]
        else:
            embeddings = Store.scratch(g.edges.sparkSession).save("embeddings", embeddings)
            keys = [x[0] for x in embeddings.select("key").distinct().collect()]  # ways in which a pattern's edges can meet
        rows = [(key, float(k), list(power), list(drawn)) for key in keys for (power, drawn), k in terms(p, tuple(int(x) for x in key.split(",") if x)).items()]
        # The table depends on the pattern, not on the graph.
        by_key = F.broadcast(g.edges.sparkSession.createDataFrame(rows, "key string, factor double, power array<int>, drawn array<int>"))
        return float(embeddings.join(by_key, "key").agg(F.coalesce(F.sum(F.col("factor") * self._product(p)), F.lit(0.0))).head()[0])

    @staticmethod
    def _edge_rows(held: Store, p: Pattern, i: int) -> DataFrame:
        """(b<src>, b<dst>, w<i>) of the summary edges that can be the i-th pattern edge."""
        e = p.edges[i]
        rows = held.table("edge").where(F.col("el") == e.el)
        if e.src == e.dst:
            return rows.where("bs = bd").select(F.col("bs").alias(f"b{e.src}"), F.col("w").cast("double").alias(f"w{i}"))
        return rows.select(F.col("bs").alias(f"b{e.src}"), F.col("bd").alias(f"b{e.dst}"), F.col("w").cast("double").alias(f"w{i}"))

    @staticmethod
    def _reduced(store: Store, p: Pattern, tables: dict[int, DataFrame], candidates: dict[int, DataFrame], order: list[int]) -> tuple[dict[int, DataFrame], list[int]]:
        """The edges' rows that are in some embedding of the pattern's spanning tree, and an order by what is left of them.

        Rows meet the candidates of both ends, then each edge its children, from the leaves
        to the root, and its parent on the way back; so no partial embedding of the tree is
        without an end.
        """
        parent: dict[int, int] = {}
        for k, i in enumerate(order):
            ends = {p.edges[i].src, p.edges[i].dst}
            found = [j for j in order[:k] if ends & {p.edges[j].src, p.edges[j].dst}]
            if found:
                parent[i] = max(found, key=lambda j: len(ends & {p.edges[j].src, p.edges[j].dst}))

        def meet(i: int, j: int) -> DataFrame:
            ends = {p.edges[i].src, p.edges[i].dst} & {p.edges[j].src, p.edges[j].dst}
            shared = [f"b{v}" for v in sorted(ends)]
            return tables[i].join(tables[j].select(*shared).distinct(), shared, "left_semi")

        tables = dict(tables)
        for i in order:
            for v in sorted({p.edges[i].src, p.edges[i].dst}):
                tables[i] = tables[i].join(candidates[v].select(f"b{v}"), f"b{v}", "left_semi")
            tables[i] = store.save(f"own{i}", tables[i])
        for i in reversed(order):
            if i in parent:
                tables[parent[i]] = store.save(f"up{parent[i]}-{i}", meet(parent[i], i))
        for i in order:
            if i in parent:
                tables[i] = store.save(f"down{i}", meet(i, parent[i]))
        size = {i: tables[i].count() for i in order}
        out, met = [], set()
        while len(out) < len(order):
            left = [i for i in order if i not in out]
            out.append(min(left, key=lambda i: (bool(met) and not met & {p.edges[i].src, p.edges[i].dst}, size[i], i)))
            met |= {p.edges[out[-1]].src, p.edges[out[-1]].dst}
        return tables, out

    @staticmethod
    def _key(p: Pattern) -> F.Column:
        """For each pattern edge the first one on the same summary edge."""
        first = []
        for i, e in enumerate(p.edges):
            at = F.lit(i)
            for j in range(i - 1, -1, -1):
                f = p.edges[j]
                if f.el == e.el:
                    at = F.when((F.col(f"b{e.src}") == F.col(f"b{f.src}")) & (F.col(f"b{e.dst}") == F.col(f"b{f.dst}")), F.lit(j)).otherwise(at)
            first.append(at.cast("string"))
        return F.concat_ws(",", *first)

    @staticmethod
    def _product(p: Pattern) -> F.Column:
        """Weights to their powers, times the chance that so many different edges are drawn from each summary edge's, without replacement."""
        times = lambda a, x: a * x
        weights = F.array(*[F.col(f"n{v.id}") for v in p.vertices])
        out = F.aggregate(F.zip_with("power", weights, lambda k, n: F.pow(n, k)), F.lit(1.0), times)
        if p.edges:
            edges = F.array(*[F.struct(F.col(f"w{i}").alias("w"), (F.col(f"n{e.src}") * F.col(f"n{e.dst}")).alias("cells")) for i, e in enumerate(p.edges)])
            turns = F.array(*[F.lit(float(i)) for i in range(len(p.edges))])

            def drawn(k: F.Column, e: F.Column) -> F.Column:
                chance = lambda i: F.when((e["w"] > i) & (e["cells"] > i), (e["w"] - i) / F.greatest(e["cells"] - i, F.lit(1.0))).otherwise(F.lit(0.0))
                return F.aggregate(turns, F.lit(1.0), lambda a, i: F.when(i < k, a * chance(i)).otherwise(a))

            out = out * F.aggregate(F.zip_with("drawn", edges, drawn), F.lit(1.0), times)
        return out

    def embeddings(self, held: Store, g: Graph, p: Pattern) -> DataFrame:
        """(b<v>, n<v> for vertices, w<i> for edges): mappings of the pattern into the summary.

        A bucket is a vertex's candidate if its type includes the vertex's own.
        """
        b, m = held.table("bucket"), held.table("member")
        candidates = {}
        for v in p.vertices:
            own = b.select(F.col("bucket").alias(f"b{v.id}"), F.col("w").cast("double").alias(f"n{v.id}"), "vls", "outs", "ins")
            own = own.where(includes("vls", {v.label} - {None}) & includes("outs", {p.edges[i].el for i in p.out_edges(v.id)}) & includes("ins", {p.edges[i].el for i in p.in_edges(v.id)}))
            if v.bound is not None:
                own = own.join(m.where(F.col("vid") == v.bound).select(F.col("bucket").alias(f"b{v.id}")), f"b{v.id}", "left_semi")
            candidates[v.id] = own.drop("vls", "outs", "ins")
        tables = {i: self._edge_rows(held, p, i) for i in range(len(p.edges))}
        order = p.join_order(g.stats)
        if len(order) > 1 and held.table("edge").where(F.col("el").isin(*{e.el for e in p.edges})).count() > self.reduce_from:
            tables, order = self._reduced(Store.scratch(g.edges.sparkSession), p, tables, candidates, order)
        acc, met = None, set()
        for i in order:
            e, rows = p.edges[i], tables[i]
            if acc is None:
                acc = rows
            else:
                shared = sorted(c for c in set(acc.columns) & set(rows.columns))
                acc = acc.join(rows, shared) if shared else acc.crossJoin(rows)  # summary rows of two parts of the pattern
            for v in sorted({e.src, e.dst} - met):
                acc = acc.join(candidates[v], f"b{v}")
            met |= {e.src, e.dst}
        for v in p.vertices:
            if v.id not in met:  # a vertex without edges is any candidate
                acc = candidates[v.id] if acc is None else acc.crossJoin(candidates[v.id])
        return acc
