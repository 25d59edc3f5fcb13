"""Random walks over pattern relations: many trials, plans and walks advance together, one table a step.

Positions come from plain orders of ids and draws from plain arithmetic on (seed, walk,
step), so a run is the same on any partitioning, and SQL can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.store import Store
from .base import asked_labels
from .graph import Graph, ranked_within

#: 2**31 - 1, the modulus of the draws.
P31 = (1 << 31) - 1


def draw(walk: Column, step: int, seed: Column | int, n: Column) -> Column:
    """A position below n."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    seed = seed.cast("long")
    a = ((seed * 7919 + (step * 104729 + 48271)) % F.lit(P31)).bitwiseOR(F.lit(1))
    b = (seed * 15485863 + (step * 32452843 + 11)) % F.lit(P31)
    y = (walk % F.lit(P31) * a + b) % F.lit(P31)
    return ((y * F.lit(16807) + F.lit(step)) % F.lit(P31)) % n


def index(g: Graph, store: Store, patterns: Iterable[Pattern] | None = None, steps: bool = True) -> Store:
    """Tables that walks look up: starts (el, i, src, dst), labelled (vl, i, vid), steps (out, el, vid, i, other) and degrees (out, el, vid, deg).

    Positions are within a label, so with ``patterns`` only their labels are numbered.
    """
    if patterns is not None:
        els, vls = asked_labels(patterns)
        g = Graph(g.vertices, g.vlabels.where(F.col("vl").isin(*vls)), g.of_labels(els).edges)
    store.save("starts", g.ranked_edges().select("el", "i", "src", "dst"), "el")
    store.save("labelled", g.ranked_vertices().select("vl", "i", "vid"))
    if not steps:
        return store
    steps = store.save("steps", _steps(g.edges), "el")
    store.save("degrees", _degrees(steps), "el")
    return store


def _steps(edges: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(out, el, vid, i, other): a vertex's neighbours by label, direction and position; only those of the few (out, el, vid) of ``at``, if given."""
    both = None
    for out in (True, False):
        a, b = ("src", "dst") if out else ("dst", "src")
        own = edges.select("el", F.col(a).alias("vid"), F.col(b).alias("other"))
        own = own.join(F.broadcast(at.where(F.col("out") == out).select("el", "vid")), ["el", "vid"], "left_semi") if at is not None else own
        own = ranked_within(own, ["el", "vid"], "el", "other").select(F.lit(out).alias("out"), "el", "vid", "i", "other")
        both = own if both is None else both.unionAll(own)
    return both


def _degrees(steps: DataFrame) -> DataFrame:
    return steps.groupBy("out", "el", "vid").agg(F.count(F.lit(1)).alias("deg"))


@dataclass(frozen=True)
class Action:
    """A step of a plan: ``edge`` or ``vertex`` starts it, ``out`` and ``in`` go from vertex a to b, ``check`` asks for an edge from a to b."""

    kind: str
    label: int
    a: int
    b: int


def actions(p: Pattern, order: list[int]) -> list[Action]:
    """The steps of an order of edges; -1 - v is a start at the labelled vertex v."""
    out, seen = [], set()
    for i in order:
        if i < 0:
            v = p.vertices[-1 - i]
            out.append(Action("vertex", v.label, v.id, v.id))
            seen.add(v.id)
            continue
        e = p.edges[i]
        if not seen:
            out.append(Action("edge", e.el, e.src, e.dst))
        elif {e.src, e.dst} <= seen:
            out.append(Action("check", e.el, e.src, e.dst))
        elif e.src in seen:
            out.append(Action("out", e.el, e.src, e.dst))
        else:
            out.append(Action("in", e.el, e.dst, e.src))
        seen |= {e.src, e.dst}
    return out


ROUTE = "plan int, kind string, label int, a int, b int, n long, bound_a long, bound_b long, vl_a int, vl_b int"


def routes(g: Graph, p: Pattern, plans: list[list[int]]) -> list[list[tuple]]:
    """ROUTE rows of each step: what every plan does there, and what its new vertices must be."""
    known = [actions(p, order) for order in plans]
    out = []
    for step in range(max(map(len, known), default=0)):
        rows = []
        for k, todo in enumerate(known):
            if step < len(todo):
                t = todo[step]
                a, b = (p.vertices[v] for v in (t.a, t.b))
                n = {"edge": g.counts["el"], "vertex": g.counts["vl"]}.get(t.kind, {}).get(t.label, 0)
                fresh_a, fresh_b = t.kind in ("edge", "vertex"), t.kind in ("edge", "out", "in")
                rows.append((k, t.kind, t.label, t.a, t.b, n, a.bound if fresh_a else None, b.bound if fresh_b else None, a.label if t.kind == "edge" else None, b.label if fresh_b else None))
        out.append(rows)
    return out


def walk(held: Store, g: Graph, p: Pattern, plans: list[list[int]], walks: DataFrame, store: Store, few: bool = False) -> list[DataFrame]:
    """Rows (seed, walk, plan, inv, v) that are left after each step of ``walks`` (seed, walk, plan); the last holds the walks that succeed.

    ``inv`` is the inverse probability, ``v`` the vertices by pattern vertex.  Each step is a
    written table in ``store``, so a lost executor costs a step.  ``few`` walks (a row a plan
    and trial) are broadcast, and their neighbours are numbered as they are met: ``held``
    needs no steps and no degrees.
    """
    spark = g.edges.sparkSession
    rows = walks.select("seed", "walk", "plan", F.lit(1.0).alias("inv"), F.array(*[F.lit(None).cast("long")] * len(p.vertices)).alias("v"))
    out = []
    for step, todo in enumerate(routes(g, p, plans)):
        # As many rows as plans, which the pattern bounds.
        routed = rows.join(F.broadcast(spark.createDataFrame(todo, ROUTE)), "plan", "left")
        rows = store.save(f"step{step}", _step(held, g, routed, step, {x[1] for x in todo}, any(x[8] is not None or x[9] is not None for x in todo), len(todo) < len(plans), store if few else None))
        out.append(rows)
    return out


def _step(held: Store, g: Graph, routed: DataFrame, step: int, kinds: set[str], labelled: bool, some_done: bool, few: Store | None = None) -> DataFrame:
    same = ["seed", "walk", "plan", "inv", "v"]
    small = F.broadcast if few is not None else lambda own: own
    parts = []

    def at(k: str) -> Column:
        return F.get("v", F.col(k))

    def put(va: Column, vb: Column) -> Column:
        return F.transform("v", lambda x, i: F.when(i == F.col("b"), vb).when(i == F.col("a"), va).otherwise(x))

    position = draw(F.col("walk"), step, F.col("seed"), F.col("n"))
    if "edge" in kinds:
        own = routed.where("kind = 'edge'").withColumns({"el": F.col("label"), "i": position})
        own = small(own).join(held.table("starts"), ["el", "i"]).where("a <> b OR src = dst")
        parts.append(own.withColumns({"inv": F.col("inv") * F.col("n"), "v": put(F.col("src"), F.col("dst"))}))
    if "vertex" in kinds:
        own = routed.where("kind = 'vertex'").withColumns({"vl": F.col("label"), "i": position})
        own = small(own).join(held.table("labelled"), ["vl", "i"])
        parts.append(own.withColumns({"inv": F.col("inv") * F.col("n"), "v": put(F.col("vid"), F.col("vid"))}))
    if kinds & {"out", "in"}:
        own = routed.where("kind IN ('out', 'in')").withColumns({"out": F.col("kind") == "out", "el": F.col("label"), "vid": at("a")})
        steps = few.save(f"near{step}", _steps(g.edges, own.select("out", "el", "vid").distinct())) if few is not None else held.table("steps")
        degrees = _degrees(steps) if few is not None else held.table("degrees")
        own = small(own).join(degrees, ["out", "el", "vid"]).withColumn("i", draw(F.col("walk"), step, F.col("seed"), F.col("deg")))
        own = small(own).join(steps, ["out", "el", "vid", "i"])
        parts.append(own.withColumns({"inv": F.col("inv") * F.col("deg"), "v": put(at("a"), F.col("other"))}))
    if "check" in kinds:
        own = routed.where("kind = 'check'").withColumns({"el": F.col("label"), "src": at("a"), "dst": at("b")})
        met = g.edges.join(small(own.select("src", "dst", "el")), ["src", "dst", "el"], "left_semi") if few is not None else g.edges
        parts.append(own.join(met, ["src", "dst", "el"], "left_semi"))
    if some_done:
        parts.append(routed.where("kind IS NULL"))
    rows = None
    for own in parts:
        own = own.select(*same, "a", "b", "bound_a", "bound_b", "vl_a", "vl_b")
        rows = own if rows is None else rows.unionAll(own)
    for k in ("a", "b"):
        rows = rows.where(F.col(f"bound_{k}").isNull() | (at(k) == F.col(f"bound_{k}")))
        if labelled:
            asked = rows.where(f"vl_{k} IS NOT NULL").withColumns({"vl": F.col(f"vl_{k}"), "vid": at(k)})
            met = g.vlabels.join(small(asked.select("vl", "vid")), ["vl", "vid"], "left_semi") if few is not None else g.vlabels
            rows = rows.where(f"vl_{k} IS NULL").unionAll(asked.join(met, ["vl", "vid"], "left_semi").drop("vl", "vid"))
    return rows.select(*same)
