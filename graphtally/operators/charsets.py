"""Characteristic sets: vertices grouped by their labels, with label frequencies, and label histograms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.store import Store
from .base import Estimator, empty
from .graph import BITS, Graph, label_bit, labels_of, tasks

#: Edge labels whose degrees are held side by side in a row.
COLUMNS = 16


def sets(g: Graph, out: bool = True) -> DataFrame:
    """(vls, els, n, freq): vertices by label lists (vls empty backwards), and edges per label as (el, deg) structs.

    Degrees, labels and bare vertices meet in one shuffle by vertex; a vertex then counts
    once for its set and once for each of its labels.
    """
    known, els = g.first_labels()
    if len(known) <= BITS and len(els) <= COLUMNS and None not in els:
        return _sets_of_few(g, known, els, out)

    def rows(df: DataFrame, kind: int, label: F.Column, deg: F.Column) -> DataFrame:
        return df.select("vid", F.lit(kind).alias("kind"), label.cast("int").alias("el"), deg.cast("long").alias("deg"))

    none = F.lit(None)
    every = rows(g.vertices, 0, none, none).unionAll(rows(g.degree(out), 2, F.col("el"), F.col("deg")))
    every = every.unionAll(rows(g.vlabels, 1, F.col("vl"), none)) if out else every
    vls = F.sort_array(F.collect_set(F.when(F.col("kind") == 1, F.col("el")))).alias("vls")
    d = F.sort_array(F.collect_list(F.when(F.col("kind") == 2, F.struct("el", "deg")))).alias("d")
    t = every.groupBy("vid").agg(vls, d, F.min("kind").alias("kind")).where("kind = 0").select("vls", F.transform("d", lambda x: x["el"]).alias("els"), "d")
    own = F.array(F.struct(none.cast("int").alias("el"), none.cast("long").alias("deg")))
    each = t.select("vls", "els", F.explode(F.concat(own, "d")).alias("x")).groupBy("vls", "els", "x.el").agg(F.count(F.lit(1)).alias("n"), F.sum("x.deg").alias("deg"))
    freq = F.sort_array(F.collect_list(F.when(F.col("el").isNotNull(), F.struct("el", "deg")))).alias("freq")
    return each.groupBy("vls", "els").agg(F.max(F.when(F.col("el").isNull(), F.col("n"))).alias("n"), freq)


def _sets_of_few(g: Graph, vls: list[int], els: list[int], out: bool) -> DataFrame:
    """``sets`` of a graph of few labels: those of a vertex are bits, and each edge label's degree is a column, so all sums are of longs."""
    degs = [f"d{i}" for i in range(len(els))]
    none, there = F.lit(0).cast("long"), F.lit(1 << BITS).cast("long")

    def rows(df: DataFrame, vid: str, bits: F.Column, deg: list[F.Column]) -> DataFrame:
        return df.select(F.col(vid).alias("vid"), bits.alias("bits"), *[x.alias(d) for x, d in zip(deg, degs, strict=True)])

    # Backwards edges are counted before they are sent, since hubs are common there; a source's edges pass through one task, which holds sums alone.
    ends = g.edges.select(F.col("src").alias("vid"), "el", F.lit(1).alias("deg")) if out else g.degree(out)
    every = rows(g.vertices, "vid", there, [none] * len(els)).unionAll(rows(ends, "vid", none, [F.when(F.col("el") == x, F.col("deg")).otherwise(0).cast("long") for x in els]))
    every = every.unionAll(rows(g.vlabels, "vid", label_bit(F.col("vl"), vls), [none] * len(els))) if out else every
    if not g.apart:  # a split of a narrow written table has any number of vertices, which are not held while it is read
        every = every.repartition(tasks(g.edges.sparkSession, g.vertices.count()), "vid")
    own = every.groupBy("vid").agg(F.bit_or("bits").alias("bits"), *[F.sum(d).alias(d) for d in degs]).where(F.col("bits").bitwiseAND(there) != 0)
    has = none
    for i, d in enumerate(degs):
        has = has.bitwiseOR(F.when(F.col(d) > 0, F.lit(1 << i).cast("long")).otherwise(none))
    each = own.withColumn("has", has).groupBy("bits", "has").agg(F.count(F.lit(1)).alias("n"), *[F.sum(d).alias(d) for d in degs])
    freq = F.array_compact(F.array(*[F.when(F.col(d) > 0, F.struct(F.lit(x).cast("int").alias("el"), F.col(d).alias("deg"))) for x, d in zip(els, degs, strict=True)])) if els else F.array().cast("array<struct<el:int,deg:bigint>>")
    return each.select(labels_of("bits", vls).alias("vls"), labels_of("has", els).alias("els"), "n", freq.alias("freq"))


def bucket_rule(g: Graph, n_sets: int) -> tuple[int, int]:
    """(number of histogram buckets, ids in a bucket) for a graph of so many sets, forward and backward."""
    nb = min(g.counts["v"] + 1, n_sets, int(1e8 / max(1, g.counts["nvl"] + g.counts["nel"])))
    return nb, max(1, (g.counts["v"] + g.counts["nvl"]) // nb)


def histogram(g: Graph, nb: int) -> DataFrame:
    """(kind, label, col, bucket, n): ids of each label's relation by bucket."""
    shift = g.counts["nvl"]
    v = g.vlabels.select(F.lit("v").alias("kind"), F.col("vl").alias("label"), F.inline(F.array(F.struct(F.lit(0).alias("col"), F.pmod(F.col("vid") + shift, F.lit(nb)).alias("bucket")), F.struct(F.lit(1).alias("col"), F.pmod(F.col("vl").cast("long"), F.lit(nb)).alias("bucket")))))
    e = g.edges.select(F.lit("e").alias("kind"), F.col("el").alias("label"), F.inline(F.array(*[F.struct(F.lit(i).alias("col"), F.pmod(F.col(c) + shift, F.lit(nb)).alias("bucket")) for i, c in enumerate(("src", "dst"))])))
    return v.unionByName(e).groupBy("kind", "label", "col", "bucket").agg(F.count(F.lit(1)).alias("n"))


class CharacteristicSets(Estimator):
    """Stars of the pattern over the sets, joined by histogram selectivities.

    ``faithful`` keeps two known habits of the method as published in code: a backward
    star covers edges a forward star had, and a leftover first triple counts as |V|.
    """

    name, fixed, whole = "cset", True, True

    def __init__(self, faithful: bool = True) -> None:
        self.faithful = faithful

    def summarize(self, g: Graph, store: Store, patterns: Iterable[Pattern] | None = None) -> Store:
        """Tables ``fwd`` and ``bwd`` (sets), ``hist`` (by kind) and ``rule`` (buckets, ids in a bucket)."""
        n = store.save("fwd", sets(g, True)).count() + store.save("bwd", sets(g, False)).count()
        nb, width = bucket_rule(g, n)
        store.save("hist", histogram(g, nb))
        store.save("rule", g.edges.sparkSession.createDataFrame([(nb, width)], "nb long, width long"))
        return store

    def decomposed(self, p: Pattern) -> tuple[list[tuple], list[tuple[int, bool, list[int]]], set[int], set[tuple[int, int]]]:
        """Triples (subject, object, kind, label; label objects are nodes of their own), stars (centre, forward, triples), covered triples, pairs still to join."""
        nv = len(p.vertices)
        triples = []
        for v in range(nv):
            if p.vertices[v].label is not None:
                triples.append((v, ("l", p.vertices[v].label), "v", p.vertices[v].label))
            triples += [(e.src, e.dst, "e", e.el) for e in p.edges if e.src == v]
        m = len(triples)
        near = {(i, j) for i in range(m) for j in range(i + 1, m) if {triples[i][0], triples[i][1]} & {triples[j][0], triples[j][1]}}
        covered, stars = set(), []
        for forward in (True, False):
            while True:
                own = {v: [i for i, t in enumerate(triples) if t[0 if forward else 1] == v and (forward or t[2] == "e")] for v in range(nv)}
                open_ = {v: [i for i in x if i not in covered] for v, x in own.items()}
                v = max(range(nv), key=lambda v: (len(open_[v]), -v))
                if len(open_[v]) < 2:
                    break
                use = own[v] if forward or self.faithful else open_[v]
                stars.append((v, forward, use))
                covered |= set(use)
                near -= {(i, j) for i in use for j in use}
        return triples, stars, covered, near

    def estimate(self, g: Graph, p: Pattern, seed: int = 0, summary: Store | None = None) -> float:
        if empty(g, p):
            return 0.0
        held = self.summary_of(g, summary, p)
        triples, stars, covered, near = self.decomposed(p)
        m = len(triples)
        result = 1.0
        for v, forward, use in stars:
            result *= self._star(held, p, triples, v, forward, use)
        for i in range(m):
            if i not in covered:
                result *= g.counts["v"] if self.faithful and i == 0 and g.counts["nvl"] else self._single(g, p, triples[i])
        if not near:
            return result
        return result * float(self._selectivities(held, [(triples[i], triples[j]) for i, j in sorted(near)]))

    @staticmethod
    def _selectivities(held: Store, pairs: list[tuple[tuple, tuple]]) -> float:
        """Product over pairs of triples of the share of their relations' product that agrees at the vertex they share, by buckets."""
        rows = []
        for k, (a, b) in enumerate(pairs):
            ca, cb = next((x, y) for x in (0, 1) for y in (0, 1) if a[x] == b[y])
            rows += [(k, 0, a[2], a[3], ca), (k, 1, b[2], b[3], cb)]
        # Two rows a pair of the pattern's triples.
        asked = F.broadcast(held.spark.createDataFrame(rows, "k int, side int, kind string, label int, col int"))
        n = [F.sum(F.when(F.col("side") == x, F.col("n")).otherwise(F.lit(0))).alias(f"n{x}") for x in (0, 1)]
        aligned = held.table("hist").join(asked, ["kind", "label", "col"]).groupBy("k", "bucket").agg(*n)
        sums = aligned.groupBy("k").agg(F.sum(F.col("n0").cast("double") * F.col("n1")).alias("both"), F.sum("n0").alias("a"), F.sum("n1").alias("b"))
        width, out = held.table("rule").head()["width"], 1.0
        for r in sums.collect():  # a row a pair
            out *= r["both"] / width / (r["a"] * r["b"])
        return out

    def _star(self, held: Store, p: Pattern, triples: list, v: int, forward: bool, use: list[int]) -> float:
        own = [triples[i] for i in use]
        s = held.table("fwd" if forward else "bwd")
        for t in own:
            s = s.where(F.array_contains("vls" if t[2] == "v" else "els", t[3]))
        freq = F.map_from_entries("freq")
        value = F.col("n").cast("double")
        least = F.lit(1.0)
        for t in own:
            if t[2] == "v":
                continue  # every vertex has a label once
            n = F.element_at(freq, t[3]).cast("double")
            if p.vertices[t[1 if forward else 0]].bound is not None:
                least = F.least(least, 1.0 / n)
            else:
                value = value * n / F.col("n")
        value = value * least
        if p.vertices[v].bound is not None:
            value = value / F.col("n")
        return float(s.agg(F.coalesce(F.sum(value), F.lit(0.0))).head()[0])

    def _single(self, g: Graph, p: Pattern, t: tuple) -> float:
        if t[2] == "v":
            if p.vertices[t[0]].bound is not None:
                return float(g.with_label(t[3]).where(F.col("vid") == p.vertices[t[0]].bound).count())
            return float(g.counts["vl"].get(t[3], 0))
        rows = g.of_label(t[3])
        for c, end in (("src", t[0]), ("dst", t[1])):
            if p.vertices[end].bound is not None:
                rows = rows.where(F.col(c) == p.vertices[end].bound)
        return float(rows.count())
