"""Random walks over the edges of a pattern's labels, closed by the vertex that they leave open."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, pairwise, permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.store import Store
from .base import Estimator, empty
from .graph import Graph
from .sampling import TRIALS, zeros
from .walks import draw, index

#: A step is (pattern edge, whether it is walked along its direction).
Path = tuple[tuple[int, ...], tuple[tuple[int, bool], ...]]


def open_paths(p: Pattern) -> list[Path]:
    """All simple paths over all vertices but one: the vertices in order, and the steps between them."""
    most = len(p.vertices) - 1

    def grow(vs: tuple[int, ...], steps: tuple[tuple[int, bool], ...]) -> Iterator[Path]:
        if len(vs) == most:
            yield vs, steps
            return
        for i, e in enumerate(p.edges):
            for here, there, out in ((e.src, e.dst, True), (e.dst, e.src, False)):
                if here == vs[-1] and there not in vs:
                    yield from grow((*vs, there), (*steps, (i, out)))

    return [path for v in range(len(p.vertices)) for path in grow((v,), ())] if most > 0 else []


def incidence(held: Store, els: set[int]) -> DataFrame:
    """(vid, out, el, low, deg, total): a vertex's half-edges of the labels in order of label and direction, by their first position; ``total`` is its degree."""
    own = held.table("degrees").where(F.col("el").isin(*els))
    whole = Window.partitionBy("vid")  # two rows a label at most
    low = F.coalesce(F.sum("deg").over(whole.orderBy("el", F.desc("out")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.select("vid", "out", "el", low.alias("low"), "deg", F.sum("deg").over(whole).alias("total"))


class RandomWalk(Estimator):
    """Mean over the windows of n - 1 vertices that slide along many walks, for patterns of n.

    A walk starts at a uniform half-edge of the pattern's labels, which is the walk's
    stationary state: it needs no time to settle and has no dead end, as every vertex that
    is met has the edge it was met by.  The window moves on with the walk, a vertex in and
    a vertex out.  Every way to lay all pattern vertices but one on a window counts the
    vertices that close the pattern; that over the window's probability and the number of
    such paths has the number of matches as its mean.  The probability is the mean over all
    orders in which the window's vertices can be walked (``orders``), as the method was
    published, or that of the window's own path, which is without bias where a window has
    edges that the pattern hasn't.  -1 for patterns of more than five vertices and such that
    no path covers, 0 without a walk in the budget, which is a share ``p`` of the pattern's
    label counts in steps.
    """

    name, batched = "impr", True

    def __init__(self, p: float = 0.03, windows: int = 4, orders: bool = True) -> None:
        self.p, self.windows, self.orders = p, windows, orders

    def summarize(self, g: Graph, store: Store, patterns: Iterable[Pattern] | None = None) -> Store:
        return index(g, store, patterns)

    def windows_of(self, p: Pattern) -> int:
        """Windows of a walk."""
        return self.windows if len(p.vertices) > 2 else 1

    def walks(self, g: Graph, p: Pattern, n: int, seeds: list[int], held: Store) -> DataFrame:
        """(seed, walk, inv, x0.., l1.., o1..): a row a window with its vertices, inverse probability, label and direction of each step.

        The state of all walks, the vertices so far with labels and directions, is a table a step.
        """
        spark, els = g.edges.sparkSession, sorted({e.el for e in p.edges})
        wide, slides, store = len(p.vertices) - 2, self.windows_of(p), Store.scratch(g.edges.sparkSession)
        steps = wide + slides - 1
        total = 2 * sum(g.counts["el"].get(el, 0) for el in els)
        around = store.save("incidence", incidence(held, set(els)))
        # Half-edges in order of label and ends, both directions of an edge in turn.
        label, low, first = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
        place = F.floor(F.col("pos") / 2)
        for el in els:
            label = F.when(place >= first, F.lit(el)).otherwise(label)
            low = F.when(place >= first, F.lit(first)).otherwise(low)
            first += g.counts["el"].get(el, 0)
        every = spark.range(len(seeds) * n).select(F.get(F.array(*[F.lit(s) for s in seeds]), (F.col("id") / n).cast("int")).alias("seed"), (F.col("id") % n).alias("walk"))
        every = every.withColumn("pos", draw(F.col("walk"), 0, F.col("seed"), F.lit(total))).withColumns({"el": label, "i": place - low, "out": F.col("pos") % 2 == 0})
        rows = every.join(held.table("starts"), ["el", "i"])
        here, there = F.when(F.col("out"), F.col("src")).otherwise(F.col("dst")), F.when(F.col("out"), F.col("dst")).otherwise(F.col("src"))
        if steps == 0:
            degree = around.select(F.col("vid").alias("x0"), "total").distinct()
            return rows.select("seed", "walk", here.alias("x0")).join(degree, "x0").select("seed", "walk", (F.lit(float(total)) / F.col("total")).alias("inv"), "x0")
        rows = store.save("walk1", rows.select("seed", "walk", F.array(here, there).alias("x"), F.array(F.struct("el", "out")).alias("s")))
        for k in range(2, steps + 1):
            at = rows.withColumn("vid", F.element_at("x", -1)).join(around, "vid").withColumn("r", draw(F.col("walk"), k, F.col("seed"), F.col("total")))
            at = at.where("low <= r AND r < low + deg").withColumn("i", F.col("r") - F.col("low")).join(held.table("steps").where(F.col("el").isin(*els)), ["out", "el", "vid", "i"])
            rows = store.save(f"walk{k}", at.select("seed", "walk", F.concat("x", F.array("other")).alias("x"), F.concat("s", F.array(F.struct("el", "out"))).alias("s")))
        window = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(slides)), lambda j: F.struct(F.slice("x", j, wide + 1).alias("x"), F.slice("s", j, wide).alias("s"))))
        rows = rows.select("seed", "walk", window.alias("window", "w"))
        rows = rows.select("seed", "walk", "window", *[F.get("w.x", F.lit(k)).alias(f"x{k}") for k in range(wide + 1)], *[F.get("w.s", F.lit(k - 1))[c].alias(f"{a}{k}") for a, c in (("l", "el"), ("o", "out")) for k in range(1, wide + 1)])
        return self._weighed(held, around, els, rows, wide + 1).withColumn("inv", F.lit(float(total)) / F.col("weight")).drop("weight", "window")

    def _weighed(self, held: Store, around: DataFrame, els: list[int], rows: DataFrame, m: int) -> DataFrame:
        """``rows`` with ``weight``, the probability of a window from its first step on: the mean over orders, or that of its own path."""
        if m < 3:
            return rows.withColumn("weight", F.lit(1.0))
        degree = around.select("vid", "total").distinct()
        every = rows.columns
        for k in range(m) if self.orders else range(1, m - 1):
            rows = rows.join(degree.select(F.col("vid").alias(f"x{k}"), F.col("total").alias(f"d{k}")), f"x{k}")
        if not self.orders:
            weight = F.lit(1.0)
            for k in range(1, m - 1):
                weight = weight / F.col(f"d{k}")
            return rows.select(*every, weight.alias("weight"))
        ties = held.table("steps").where(F.col("el").isin(*els)).groupBy("vid", "other").agg(F.count(F.lit(1)).alias("n"))
        for i, j in combinations(range(m), 2):
            rows = rows.join(ties.select(F.col("vid").alias(f"x{i}"), F.col("other").alias(f"x{j}"), F.col("n").alias(f"m{i}{j}")), [f"x{i}", f"x{j}"], "left")
        total, ways = F.lit(0.0), F.lit(0.0)
        for order in permutations(range(m)):
            way, chance = F.lit(1.0), F.lit(1.0)
            for i, j in pairwise(order):
                way = way * F.coalesce(F.col(f"m{min(i, j)}{max(i, j)}"), F.lit(0))
            for k in order[1:-1]:
                chance = chance / F.col(f"d{k}")
            total, ways = total + way * chance, ways + way
        return rows.select(*every, (total / ways).alias("weight"))

    def _closed(self, g: Graph, p: Pattern, rows: DataFrame, left: int) -> DataFrame:
        """(seed, inv, cnt) of laid walks (seed, inv, v<i> for all vertices but ``left``): the vertices that close the pattern."""
        for v in p.vertices:
            if v.id != left and v.bound is not None:
                rows = rows.where(F.col(f"v{v.id}") == v.bound)
            if v.id != left and v.label is not None:
                rows = rows.join(g.with_label(v.label).withColumnRenamed("vid", f"v{v.id}"), f"v{v.id}", "left_semi")

        def ends(el: int, src: str, dst: str) -> DataFrame:
            e = g.of_label(el)
            return e.where("src = dst").select(F.col("src").alias(src)) if src == dst else e.select(F.col("src").alias(src), F.col("dst").alias(dst))

        for e in p.edges:
            if left not in (e.src, e.dst):
                names = list(dict.fromkeys((f"v{e.src}", f"v{e.dst}")))
                rows = rows.join(ends(e.el, f"v{e.src}", f"v{e.dst}"), names, "left_semi")
        meets = sorted({e for e in p.edges if left in (e.src, e.dst)}, key=lambda e: (e.src == e.dst, g.counts["el"].get(e.el, 0)))
        first, *others = meets
        here = f"v{first.dst if first.src == left else first.src}"
        close = ends(first.el, f"v{first.src}", f"v{first.dst}")
        if p.vertices[left].bound is not None:
            close = close.where(F.col(f"v{left}") == p.vertices[left].bound)
        if p.vertices[left].label is not None:
            close = close.join(g.with_label(p.vertices[left].label).withColumnRenamed("vid", f"v{left}"), f"v{left}", "left_semi")
        if not others:  # a degree says it; no neighbour is listed
            return rows.join(close.groupBy(here).agg(F.count(F.lit(1)).alias("cnt")), here).select("seed", "inv", "cnt")
        rows = rows.join(close, here)
        for e in others:
            names = list(dict.fromkeys((f"v{e.src}", f"v{e.dst}")))
            rows = rows.join(ends(e.el, f"v{e.src}", f"v{e.dst}"), names, "left_semi")
        return rows.select("seed", "inv", F.lit(1).cast("long").alias("cnt"))

    def estimate(self, g: Graph, p: Pattern, seed: int = 0, summary: Store | None = None) -> float:
        return float(self.trials(g, p, [seed], summary).head()["est"])

    def trials(self, g: Graph, p: Pattern, seeds: list[int], summary: Store | None = None) -> DataFrame:
        """(seed, est) of each seed's trial."""
        spark, n, paths = g.edges.sparkSession, len(p.vertices), open_paths(p) if len(p.vertices) <= 5 else []
        if not paths or len(p.parts()) != 1:
            return spark.createDataFrame([(s, -1.0) for s in seeds], TRIALS)
        slides = self.windows_of(p)
        walks = int(self.p * sum(g.counts["el"].get(e.el, 0) for e in p.edges)) // (n + slides - 1)
        if walks <= 0 or empty(g, p):
            return zeros(g, seeds)
        rows, laid = self.walks(g, p, walks, seeds, self.summary_of(g, summary, p)), []
        for vs, steps in paths:
            fits = F.lit(True)
            for k, (i, out) in enumerate(steps, 1):
                fits = fits & (F.col(f"l{k}") == p.edges[i].el) & (F.col(f"o{k}") == out)
            left = next(v for v in range(n) if v not in vs)
            at = F.array(*[F.col(f"x{vs.index(v)}") if v in vs else F.lit(None).cast("long") for v in range(n)])
            laid.append(F.when(fits, F.struct(F.lit(left).alias("left"), at.alias("at"))))
        rows = rows.select("seed", "inv", F.explode(F.filter(F.array(*laid), lambda x: x.isNotNull())).alias("x"))
        rows = Store.scratch(spark).save("laid", rows)
        parts = None
        for left in sorted({next(v for v in range(n) if v not in vs) for vs, _ in paths}):
            own = rows.where(F.col("x.left") == left).select("seed", "inv", *[F.col("x.at")[v].alias(f"v{v}") for v in range(n) if v != left])
            own = self._closed(g, p, own, left)
            parts = own if parts is None else parts.unionAll(own)
        sums = parts.groupBy("seed").agg(F.sum(F.col("inv") * F.col("cnt")).alias("total"))
        given = spark.createDataFrame([(s,) for s in seeds], "seed int")
        return given.join(sums, "seed", "left").select("seed", (F.coalesce("total", F.lit(0.0)) / (len(paths) * walks * slides)).alias("est"))
