"""Exact homomorphism counts through joins that carry counts.

A vertex that no later edge needs is summed away at once, so an acyclic pattern costs
one aggregation per edge and no intermediate grows with the number of matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from .graph import TASK_ROWS, Graph, tasks


def edge_rows(g: Graph, p: Pattern, i: int) -> DataFrame:
    """(v<src>, v<dst>) of the i-th pattern edge under bounds and vertex labels; a loop has one column."""
    e = p.edges[i]
    rows = g.of_label(e.el).select(F.col("src").alias(f"v{e.src}"), F.col("dst").alias("_d"))
    rows = rows.where(F.col(f"v{e.src}") == F.col("_d")).drop("_d") if e.src == e.dst else rows.withColumnRenamed("_d", f"v{e.dst}")
    for v in {e.src, e.dst}:
        if p.vertices[v].bound is not None:
            rows = rows.where(F.col(f"v{v}") == p.vertices[v].bound)
        if p.vertices[v].label is not None:
            rows = rows.join(g.with_label(p.vertices[v].label).withColumnRenamed("vid", f"v{v}"), f"v{v}", "left_semi")
    return rows


def count(g: Graph, p: Pattern) -> DataFrame:
    """One row: matches (long), pattern vertices mapped freely (homomorphisms).

    Unconnected parts are counted one by one and multiplied.
    """
    out = None
    for part in p.parts():
        one = _count_connected(g, part)
        out = one if out is None else out.crossJoin(one.withColumnRenamed("matches", "_more")).select((F.col("matches") * F.col("_more")).alias("matches"))  # one row each
    return out


def _count_connected(g: Graph, p: Pattern) -> DataFrame:
    steps = p.join_steps(g.stats)
    order = [i for i, _ in steps]
    acc, cols = None, set()
    for at, i in enumerate(order):
        rows = edge_rows(g, p, i)
        needed = {f"v{v}" for j in order[at + 1 :] for v in (p.edges[j].src, p.edges[j].dst)}
        new = set(rows.columns)
        if len(new - needed - cols):  # an end that nothing else meets is a count before it is joined
            new &= needed | cols
            rows = rows.groupBy(*sorted(new)).agg(F.count(F.lit(1)).alias("k"))
        else:
            rows = rows.withColumn("k", F.lit(1).cast("long"))
        if acc is None:
            acc = rows.withColumnRenamed("k", "n")
        else:
            held = steps[at - 1][1], float(g.stats["el"].get(p.edges[i].el, 0))
            if new == cols and len(new) == 2 and min(held) > TASK_ROWS:
                # The edge only tests pairs: each is one row of the smaller side, and the other is not sorted.
                n = tasks(g.edges.sparkSession, held[1])
                acc, rows = acc.repartition(n, *sorted(new)), rows.repartition(n, *sorted(new)).hint("shuffle_hash")
            acc = acc.join(rows, sorted(cols & new)).withColumn("n", F.col("n") * F.col("k")).drop("k")
        cols |= new
        keep = sorted(cols & needed)
        if len(keep) < len(cols) and at + 1 < len(order):
            after = p.edges[order[at + 1]]
            if {f"v{after.src}", f"v{after.dst}"} == set(keep) and len(keep) == 2 and steps[at][1] > TASK_ROWS:
                acc = acc.select(*keep, "n")  # the next edge drops pairs before any are summed
            else:
                acc = acc.groupBy(*keep).agg(F.sum("n").alias("n"))
            cols = set(keep)
    return acc.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"))


def count_sql(p: Pattern) -> str:
    """The same count as SQL over ``edges`` and ``vlabels``."""
    tables, conditions, first = [], [], {}
    for i, e in enumerate(p.edges):
        tables.append(f"edges e{i}")
        conditions.append(f"e{i}.el = {e.el}")
        for v, c in ((e.src, "src"), (e.dst, "dst")):
            conditions += [f"{first[v]} = e{i}.{c}"] if v in first else []
            first.setdefault(v, f"e{i}.{c}")
    for v in p.vertices:
        if v.bound is not None:
            conditions.append(f"{first[v.id]} = {v.bound}")
        if v.label is not None:
            conditions.append(f"{first[v.id]} IN (SELECT vid FROM vlabels WHERE vl = {v.label})")
    return f"SELECT count(*)::BIGINT AS matches FROM {', '.join(tables)} WHERE {' AND '.join(conditions)}"
