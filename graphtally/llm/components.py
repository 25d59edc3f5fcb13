"""Connected components of links: contracted within each task, then by alternating stars in shuffles.

What at most ``AT_ONCE`` links are left after contraction is finished in one task; the
stars are for all that is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Links that a task holds at once.
AT_ONCE = 1 << 16


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of the links."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return names, names[root]
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root != (jump := root[root])).any():
            root = jump


def _contracted(links: DataFrame, whole: bool) -> DataFrame:
    """Links (u, v), u > v, that join the same nodes: stars of at most ``AT_ONCE`` links of a task; ``whole``: and u = v for their centres."""
    most = AT_ONCE

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        node, root = least_nodes(u, v)
        asked = np.ones(len(node), bool) if whole else node != root
        return pa.RecordBatch.from_pydict({"u": pa.array(node[asked]), "v": pa.array(root[asked])})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                if n + part.num_rows > most:
                    yield stars(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield stars(held)

    return links.select("u", "v").mapInArrow(rows, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) with u > v."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # The least neighbour of a node is found before the shuffle as far as possible; no list of neighbours is built.
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(least, "u")
    met = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return met.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long), written; the root is the component's least node.

    Each step's edges are a table in the shared folder, so a lost executor costs one
    step; the loop ends when a round leaves the edges as they were.
    """
    spark = links.sparkSession
    edges = written(_contracted(links.where("u <> v"), False), "edges")

    def named(df: DataFrame) -> DataFrame:
        out = written(df.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
        drop_written(spark, edges)
        return out

    if edges.count() <= AT_ONCE:
        return named(_contracted(edges.coalesce(1), True))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).head())

    seen = mark(edges)
    while True:
        after = written(_star(_star(edges, True), False), "edges")
        drop_written(spark, edges)
        edges, now = after, mark(after)
        if now == seen:
            break
        seen = now
    return named(edges.unionAll(edges.select(F.col("v").alias("u"), "v").distinct()))
