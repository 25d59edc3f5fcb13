"""Sampling estimators: correlated hash samples, random join walks, walks closed by exact weights.

Trials are data: all walks of all trials and plans advance together, one table a step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.pattern import Pattern, relations
from ..plans.store import Store
from .base import Estimator, empty
from .bound_sketch import table
from .exact import edge_rows
from .graph import Graph
from .walks import draw, index, walk

#: 2**61 - 1, the modulus of the sample hash.
P61 = (1 << 61) - 1


def unit_hash(x: Column, s1: int, s2: int) -> Column:
    """((s1*x + s2) mod 2**64) mod (2**61-1), scaled to [0, 1); exact in decimals."""
    wide = "decimal(38,0)"
    y = (F.lit(str(s1)).cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast(wide) + F.lit(str(s2)).cast(wide)
    return ((y % F.lit(str(1 << 64)).cast(wide)) % F.lit(str(P61)).cast(wide)).cast("double") / F.lit(float(P61))


class CorrelatedSampling(Estimator):
    """Tuples stay where the hash of every join attribute lies under its least rate; the join of the samples is scaled."""

    name = "cs"

    def __init__(self, p: float = 0.03) -> None:
        self.p = p

    def samples(self, g: Graph, p: Pattern, seed: int) -> tuple[list[DataFrame], float]:
        rs = relations(p)
        rate: dict[int, float] = {}
        for r in rs:
            for a, _ in r.attrs:
                rate[a] = min(rate.get(a, 1.0), self.p ** (1 / max(1, len({a for a, _ in r.attrs}))))
        out, scale = [], 1.0
        for a in rate:
            scale *= rate[a]
        for r in rs:
            rows = table(g, r)
            names: dict[int, str] = {}
            for a, c in r.attrs:
                if a in names:  # a loop
                    rows = rows.where(F.col(names[a]) == F.col(f"c{c}"))
                names.setdefault(a, f"c{c}")
                s1, s2 = (2862933555777941757 + 3037000493 * (seed * 131 + a)) % (1 << 62) | 1, (1442695040888963407 * (a + 1) + seed) % (1 << 62)
                if rate[a] < 1:
                    rows = rows.where(unit_hash(F.col(f"c{c}"), s1, s2) < rate[a])
            rows = rows.select(*[F.col(c).alias(f"v{a}") for a, c in names.items()]) if names else rows.agg(F.count(F.lit(1)).alias("_n"))
            out.append(rows)
        return out, scale

    def estimate(self, g: Graph, p: Pattern, seed: int = 0, summary: Store | None = None) -> float:
        if empty(g, p):
            return 0.0
        parts, scale = self.samples(g, p, seed)
        total, left = 1.0, [x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("w")) for x in parts if "_n" not in x.columns]
        for x in parts:
            total *= x.head()[0] if "_n" in x.columns else 1
        while left:
            acc = left.pop(0)
            while more := next((x for x in sorted(left, key=lambda x: -len(set(x.columns) & set(acc.columns))) if set(x.columns) & set(acc.columns) - {"w"}), None):
                left = [x for x in left if x is not more]
                shared = sorted(set(more.columns) & set(acc.columns) - {"w"})
                acc = acc.join(more.withColumnRenamed("w", "w2"), shared).withColumn("w", F.col("w") * F.col("w2")).drop("w2")
                keep = sorted({c for c in acc.columns if any(c in x.columns for x in left)} - {"w"})
                acc = acc.groupBy(*keep).agg(F.sum("w").alias("w"))
            total *= acc.agg(F.coalesce(F.sum("w"), F.lit(0))).head()[0]
        return total / scale


def budget(g: Graph, p: Pattern, rate: float) -> int:
    """Walks of a run: the rate of the mean relation size, both cut to whole numbers."""
    sizes = [g.counts["vl"].get(v.label, 0) for v in p.vertices if v.label is not None] + [g.counts["el"].get(e.el, 0) for e in p.edges]
    return int(int(sum(sizes) / len(sizes)) * rate)


def walk_plans(p: Pattern, most: int, labels: bool = False) -> Iterator[list[int]]:
    """Orders of the edges in which each meets an earlier one, the starts taken in turn.

    With ``labels`` an order may also start at a labelled vertex v, written -1 - v.
    """

    def grow(order: list[int], seen: set[int]) -> Iterator[list[int]]:
        if sum(i >= 0 for i in order) == len(p.edges):
            yield order
            return
        for i, e in enumerate(p.edges):
            if i not in order and {e.src, e.dst} & seen:
                yield from grow([*order, i], seen | {e.src, e.dst})

    left = [grow([i], {e.src, e.dst}) for i, e in enumerate(p.edges)]
    if labels:
        left += [grow([-1 - v.id], {v.id}) for v in p.vertices if v.label is not None]
    n = 0
    while left and n < most:
        for own in list(left):
            order = next(own, None)
            if order is None:
                left.remove(own)
            elif n < most:
                n += 1
                yield order


def zeros(g: Graph, seeds: list[int]) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([(s, 0.0) for s in seeds], TRIALS)


TRIALS = "seed int, est double"


class WanderJoin(Estimator):
    """Horvitz-Thompson mean of random walks over the pattern's edges and vertex labels.

    A walk starts at a random edge or a random vertex of a label; labels of vertices that it
    meets later are membership tests of probability 1.  Walks take the plans (orders of the
    relations, as many as there are walks at most) in turn until a plan has succeeded
    ``enough`` times; of the plans with half as many successes, the one of least variance
    times mean look-ups takes all further walks.  The mean is over all walks of the budget,
    failed ones as 0.  Walks are made some time before it is known that a plan has enough,
    ``trial`` a plan at first and twice as many each time; those after that point don't count.
    """

    name, batched = "wj", True

    def __init__(self, p: float = 0.03, trial: int = 128, enough: int = 100) -> None:
        self.p, self.trial, self.enough = p, trial, enough

    def summarize(self, g: Graph, store: Store, patterns: Iterable[Pattern] | None = None) -> Store:
        return index(g, store, patterns)

    def estimate(self, g: Graph, p: Pattern, seed: int = 0, summary: Store | None = None) -> float:
        return float(self.trials(g, p, [seed], summary).head()["est"])

    def trials(self, g: Graph, p: Pattern, seeds: list[int], summary: Store | None = None) -> DataFrame:
        """(seed, est) of each seed's trial."""
        spark, n = g.edges.sparkSession, budget(g, p, self.p)
        plans = list(walk_plans(p, n, labels=True)) if n > 0 and not empty(g, p) else []
        if not plans:
            return zeros(g, seeds)
        held, won, seen = self.summary_of(g, summary, p), [], []
        shared = {s: 0 for s in seeds} if len(plans) == 1 else {}  # walks that take the plans in turn
        best = {s: 0 for s in seeds} if len(plans) == 1 else {}
        low, high = 0, min(n, len(plans) * self.trial)
        while (left := [s for s in seeds if s not in shared]) and low < n:
            every = spark.range(len(left) * (high - low)).select(F.get(F.array(*[F.lit(s) for s in left]), (F.col("id") / (high - low)).cast("int")).alias("seed"), (F.col("id") % (high - low) + low).alias("walk"))
            steps = walk(held, g, p, plans, every.withColumn("plan", (F.col("walk") % len(plans)).cast("int")), Store.scratch(spark))
            won.append(steps[-1].select("seed", "walk", "plan", "inv"))
            seen += [x.select("seed", "walk", "plan") for x in steps[:-1]]
            turn = F.row_number().over(Window.partitionBy("seed", "plan").orderBy("walk"))
            full = self._all(won).withColumn("k", turn).where(F.col("k") == self.enough).groupBy("seed").agg(F.min("walk").alias("walk"))
            now = {r["seed"]: r["walk"] + 1 for r in full.collect() if r["seed"] in left}  # a row a trial
            shared |= now
            if now:
                best |= self._best(spark, self._all(won), self._all(seen) if seen else None, now, len(plans))
            low, high = high, min(n, 2 * high)
        shared = {s: shared.get(s, n) for s in seeds}
        upto = spark.createDataFrame([(s, k, best.get(s)) for s, k in shared.items()], "seed int, shared long, best int")
        parts = [self._all(won).join(F.broadcast(upto), "seed").where("walk < shared").select("seed", "inv")] if won else []
        if any(k < n for k in shared.values()):
            every = spark.range(len(seeds) * n).select(F.get(F.array(*[F.lit(s) for s in seeds]), (F.col("id") / n).cast("int")).alias("seed"), (F.col("id") % n).alias("walk"))
            rest = every.join(F.broadcast(upto), "seed").where("walk >= shared").select("seed", "walk", F.col("best").alias("plan"))
            parts.append(walk(held, g, p, plans, rest, Store.scratch(spark))[-1].select("seed", "inv"))
        sums = self._all(parts).groupBy("seed").agg(F.sum("inv").alias("total"))
        return upto.join(sums, "seed", "left").select("seed", (F.coalesce("total", F.lit(0.0)) / n).alias("est"))

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionAll(x)
        return out

    def _best(self, spark: SparkSession, won: DataFrame, seen: DataFrame | None, shared: dict[int, int], plans: int) -> dict[int, int]:
        """The plan of least variance times mean look-ups of each trial, by its walks until then."""
        upto = F.broadcast(spark.createDataFrame(list(shared.items()), "seed int, shared long"))
        stats = won.join(upto, "seed").where("walk < shared").groupBy("seed", "plan", "shared").agg(F.sum("inv").alias("s"), F.sum(F.col("inv") * F.col("inv")).alias("q"), F.count(F.lit(1)).alias("won")).where(F.col("won") >= self.enough / 2)
        looks = seen.join(upto, "seed").where("walk < shared").groupBy("seed", "plan").agg(F.count(F.lit(1)).alias("looks")) if seen is not None else None
        stats = stats.join(looks, ["seed", "plan"], "left") if looks is not None else stats.withColumn("looks", F.lit(0))
        walks = F.floor((F.col("shared") - F.col("plan") + plans - 1) / plans)
        # Every walk looks up its start, and one relation more after each step that it survives but the last.
        cost = (F.col("q") - F.col("s") * F.col("s") / walks) / F.greatest(walks - 1, F.lit(1)) * (1 + F.coalesce("looks", F.lit(0)) / walks)
        return {r["seed"]: r["plan"] for r in stats.groupBy("seed").agg(F.min_by("plan", F.struct(cost, F.col("plan"))).alias("plan")).collect()}


def completions(g: Graph, p: Pattern, order: list[int]) -> DataFrame:
    """(v<src>, v<dst>, w) of the order's first edge: how many ways the later ones extend each tuple.

    The order is a join tree: every later edge meets the earlier ones in one vertex.
    Messages go from the last edge to the first, one aggregation each.
    """
    rows = {i: edge_rows(g, p, i).withColumn("w", F.lit(1.0)) for i in order}
    seen: list[int] = []
    parent = {}
    for i in order:
        ends = {p.edges[i].src, p.edges[i].dst}
        parent[i] = next(((j, v) for j in seen for v in ends & {p.edges[j].src, p.edges[j].dst}), None)
        seen.append(i)
    for i in reversed(order[1:]):
        j, v = parent[i]
        message = rows[i].groupBy(f"v{v}").agg(F.sum("w").alias("_m"))
        rows[j] = rows[j].join(message, f"v{v}").withColumn("w", F.col("w") * F.col("_m")).drop("_m")
    return rows[order[0]]


def tree_plans(p: Pattern, most: int) -> list[list[int]]:
    """Join trees of the pattern, without repeats: orders in which each kept edge meets the earlier ones in one vertex.

    Edges that would close a cycle are dropped, so a cyclic pattern has several trees.
    """
    out, known = [], set()
    for order in walk_plans(p, most):
        seen, kept = {p.edges[order[0]].src, p.edges[order[0]].dst}, [order[0]]
        for i in order[1:]:
            ends = {p.edges[i].src, p.edges[i].dst}
            if len(ends & seen) == 1 and len(ends) == 2:
                kept.append(i)
                seen |= ends
        if (kept[0], frozenset(kept)) not in known:
            known.add((kept[0], frozenset(kept)))
            out.append(kept)
    return out


def sampled_completions(g: Graph, p: Pattern, order: list[int], starts: DataFrame, store: Store) -> DataFrame:
    """``starts`` (v<i> of the order's first edge and further columns) with ``w``, how many ways the later edges extend each.

    From the start outwards, each edge keeps only the tuples that meet what is kept of its
    parent; weights then go back over these.  Tables are written once and read twice.
    Rows that nothing extends stay with 0: only the right side of a left join is ever broadcast,
    and written starts may be few bytes and many rows.
    """
    parent, seen = {}, [order[0]]
    for i in order[1:]:
        ends = {p.edges[i].src, p.edges[i].dst}
        parent[i] = next((j, v) for j in seen for v in ends & {p.edges[j].src, p.edges[j].dst})
        seen.append(i)
    rows = {order[0]: starts.withColumn("w", F.lit(1.0))}
    for i in order[1:]:
        j, v = parent[i]
        rows[i] = store.save(f"kept{i}", edge_rows(g, p, i).join(rows[j].select(f"v{v}").distinct(), f"v{v}", "left_semi")).withColumn("w", F.lit(1.0))
    for i in reversed(order[1:]):
        j, v = parent[i]
        message = rows[i].groupBy(f"v{v}").agg(F.sum("w").alias("_m"))
        rows[j] = rows[j].join(message, f"v{v}", "left").withColumn("w", F.col("w") * F.coalesce("_m", F.lit(0.0))).drop("_m")
    return rows[order[0]]


class JSub(Estimator):
    """Drawn start tuples closed by exact weights over an acyclic part of the pattern: an upper bound in expectation on cyclic ones.

    Of the join trees, as many as the budget has walks at most, the one whose trial walk has
    the least inverse probability is taken; trees whose trial fails are passed over, and the
    first stands if all fail.  Start tuples are drawn first and what they can't meet is never
    joined; the mean over the draws of their weights times the start's tuples is the estimate.
    Where there are more draws than tuples, a tuple is one row of a trial with its number of draws.
    """

    name, batched = "jsub", True

    def __init__(self, p: float = 0.03, full: bool = False) -> None:
        self.p, self.full = p, full

    def summarize(self, g: Graph, store: Store, patterns: Iterable[Pattern] | None = None) -> Store:
        return store if self.full else index(g, store, patterns, steps=False)  # all starts are no draws

    def estimate(self, g: Graph, p: Pattern, seed: int = 0, summary: Store | None = None) -> float:
        if self.full and not empty(g, p):
            return float(completions(g, p, tree_plans(p, 1)[0]).agg(F.coalesce(F.sum("w"), F.lit(0.0))).head()[0])
        return float(self.trials(g, p, [seed], summary).head()["est"])

    def trees(self, g: Graph, p: Pattern, plans: list[list[int]], seeds: list[int], held: Store) -> dict[int, int]:
        """The tree of each trial, by a walk over each tree."""
        if len(plans) == 1:
            return dict.fromkeys(seeds, 0)
        spark = g.edges.sparkSession
        every = spark.range(len(seeds) * len(plans)).select(F.get(F.array(*[F.lit(s) for s in seeds]), (F.col("id") / len(plans)).cast("int")).alias("seed"), (F.col("id") % len(plans)).alias("walk"))
        last = walk(held, g, p, plans, every.withColumn("plan", F.col("walk").cast("int")), Store.scratch(spark), few=True)[-1]
        found = last.groupBy("seed").agg(F.min_by("plan", F.struct("inv", "plan")).alias("plan")).collect()  # a row a trial
        return dict.fromkeys(seeds, 0) | {r["seed"]: r["plan"] for r in found}

    def trials(self, g: Graph, p: Pattern, seeds: list[int], summary: Store | None = None) -> DataFrame:
        """(seed, est) of each seed's trial."""
        spark, n = g.edges.sparkSession, budget(g, p, self.p)
        if n <= 0 or empty(g, p):
            return zeros(g, seeds)
        held, plans = self.summary_of(g, summary, p), tree_plans(p, n)
        chosen, parts = self.trees(g, p, plans, seeds, held), []
        for k in sorted(set(chosen.values())):
            own, order = [s for s in seeds if chosen[s] == k], plans[k]
            e, size = p.edges[order[0]], g.counts["el"][p.edges[order[0]].el]
            every = spark.range(len(own) * n).select(F.get(F.array(*[F.lit(s) for s in own]), (F.col("id") / n).cast("int")).alias("seed"), (F.col("id") % n).alias("walk"))
            drawn = every.select("seed", draw(F.col("walk"), len(order), F.col("seed"), F.lit(size)).alias("i"), F.lit(1).cast("long").alias("k"))
            drawn = drawn.groupBy("seed", "i").agg(F.sum("k").alias("k")) if n > size else drawn
            drawn = drawn.join(held.table("starts").where(F.col("el") == e.el), "i")
            ends = [F.col("src").alias(f"v{e.src}")] + [F.col("dst").alias(f"v{e.dst}")] * (e.src != e.dst)
            drawn = drawn.where("src = dst") if e.src == e.dst else drawn
            store = Store.scratch(spark)
            # What a start must be by itself, its labels and bounds, its edge's own rows say.
            starts = store.save("starts", drawn.select("seed", "k", *ends))
            fits = edge_rows(g, p, order[0]) if any(p.vertices[v].bound is not None or p.vertices[v].label is not None for v in (e.src, e.dst)) else None
            starts = starts.join(fits, sorted({f"v{e.src}", f"v{e.dst}"}), "left_semi") if fits is not None else starts
            weights = sampled_completions(g, p, order, starts, store)
            sums = weights.groupBy("seed").agg(F.sum(F.col("k") * F.col("w")).alias("w"))
            given = spark.createDataFrame([(s,) for s in own], "seed int")
            parts.append(given.join(sums, "seed", "left").select("seed", (F.coalesce("w", F.lit(0.0)) * float(size) / n).alias("est")))
        return WanderJoin._all(parts)
