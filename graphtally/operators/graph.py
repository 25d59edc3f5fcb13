"""A directed graph with labelled edges and vertices of any number of labels, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.store import Store


@dataclass
class Graph:
    """vertices (vid), vlabels (vid, vl), edges (src, dst, el)."""

    vertices: DataFrame
    vlabels: DataFrame
    edges: DataFrame
    #: Whether each partition of ``edges`` holds one label, so that they are written by label where they lie.
    apart: bool = False
    #: (src, dst, el) before repeats were dropped, for what repeats don't change; ``edges`` if there is none.
    repeated: DataFrame | None = None

    def of_labels(self, els: set[int]) -> Graph:
        """All vertices with the edges of some labels."""
        repeated = self.repeated.where(F.col("el").isin(*els)) if self.repeated is not None else None
        return Graph(self.vertices, self.vlabels, self.edges.where(F.col("el").isin(*els)), self.apart, repeated)

    @property
    def incidences(self) -> DataFrame:
        """The edges, perhaps some of them several times."""
        return self.repeated if self.repeated is not None else self.edges

    def of_label(self, el: int) -> DataFrame:
        return self.edges.where(F.col("el") == el)

    def with_label(self, vl: int) -> DataFrame:
        return self.vlabels.where(F.col("vl") == vl).select("vid")

    def elabel_counts(self) -> DataFrame:
        return self.edges.groupBy("el").agg(F.count(F.lit(1)).alias("n"))

    def vlabel_counts(self) -> DataFrame:
        return self.vlabels.groupBy("vl").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def counts(self) -> dict:
        """Counts on the driver, one entry per label."""
        return self._counted({r[0]: r[1] for r in self.elabel_counts().collect()}) if "stats" not in self.__dict__ else self.stats

    @cached_property
    def stats(self) -> dict:
        """``counts`` with distinct ends, which are estimates, for planning only."""
        ends = self.edges.groupBy("el").agg(F.count(F.lit(1)), *[F.approx_count_distinct(c, 0.02) for c in ("src", "dst")]).collect()
        els, src, dst = ({r[0]: r[k] for r in ends} for k in (1, 2, 3))
        return self._counted(els) | {"src": src, "dst": dst}

    def _counted(self, els: dict) -> dict:
        vls = {r[0]: r[1] for r in self.vlabel_counts().collect()}
        return {"el": els, "vl": vls, "v": self.vertices.count(), "e": sum(els.values()), "nvl": max(vls, default=-1) + 1, "nel": max(els, default=-1) + 1}

    def stored(self, store: Store) -> Graph:
        """The same graph as written tables, edges in a folder per label."""
        edges = self.edges if self.apart else self.edges.repartition("el", F.pmod(F.xxhash64("src"), F.lit(64)))
        edges = edges.sortWithinPartitions("el", "src", "dst")
        return Graph(store.save("vertices", self.vertices), store.save("vlabels", self.vlabels), store.save("edges", edges, "el").select("src", "dst", "el"))

    def vlabel_cardinality(self) -> DataFrame:
        """(vid, n): number of labels of each vertex; ``stats["nvl"]`` is that of the graph."""
        own = self.vlabels.groupBy("vid").agg(F.count_distinct("vl").alias("n"))
        return self.vertices.join(own, "vid", "left").select("vid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    def elabel_cardinality(self, out: bool = True) -> DataFrame:
        """(vid, n): number of edge labels at each vertex; ``stats["nel"]`` is that of the graph."""
        own = self.edges.groupBy(F.col("src" if out else "dst").alias("vid")).agg(F.count_distinct("el").alias("n"))
        return self.vertices.join(own, "vid", "left").select("vid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    def elabel_ordinal(self, el: int, out: bool = True) -> DataFrame:
        """(vid, i): position of the label among the vertex's sorted labels, -1 where it has none."""
        own = self.incident_labels(out).select("vid", (F.array_position("els", F.lit(el)) - 1).alias("i"))
        return self.vertices.join(own, "vid", "left").select("vid", F.coalesce("i", F.lit(-1).cast("long")).alias("i"))

    def degree(self, out: bool = True) -> DataFrame:
        """(vid, el, deg)."""
        return self.edges.groupBy(F.col("src" if out else "dst").alias("vid"), "el").agg(F.count(F.lit(1)).alias("deg"))

    def neighbours(self, out: bool = True) -> DataFrame:
        """(vid, el, adj): sorted neighbours; for export of moderate degrees, joins never use it."""
        a, b = ("src", "dst") if out else ("dst", "src")
        return self.edges.groupBy(F.col(a).alias("vid"), "el").agg(F.sort_array(F.collect_list(b)).alias("adj"))

    def incident_labels(self, out: bool = True) -> DataFrame:
        """(vid, els): sorted distinct labels."""
        return self.edges.groupBy(F.col("src" if out else "dst").alias("vid")).agg(F.sort_array(F.collect_set("el")).alias("els"))

    def first_labels(self) -> tuple[list[int], list[int]]:
        """The least labels of vertices and of edges; more than BITS of a kind say that there are more."""
        return tuple([r[0] for r in df.select(c).distinct().sort(c).limit(BITS + 1).collect()] for df, c in ((self.vlabels, "vl"), (self.incidences, "el")))

    def vertex_types(self) -> DataFrame:
        """(vid, vls, outs, ins): sorted label lists, empty for none; one shuffle for all of it."""

        def rows(df: DataFrame, vid: str, kind: int, label: F.Column) -> DataFrame:
            return df.select(F.col(vid).alias("vid"), F.lit(kind).alias("kind"), label.cast("int").alias("label"))

        vls, els = self.first_labels()
        if max(len(vls), len(els)) <= BITS:
            return self._types_of_few(vls, els)
        every = rows(self.vertices, "vid", 0, F.lit(None)).unionAll(rows(self.vlabels, "vid", 1, F.col("vl"))).unionAll(rows(self.edges, "src", 2, F.col("el"))).unionAll(rows(self.edges, "dst", 3, F.col("el")))
        lists = [F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("label")))).alias(c) for k, c in ((1, "vls"), (2, "outs"), (3, "ins"))]
        return every.groupBy("vid").agg(*lists, F.min("kind").alias("kind")).where("kind = 0").drop("kind")

    def _types_of_few(self, vls: list[int], els: list[int]) -> DataFrame:
        """``vertex_types`` of a graph whose labels fit a long's bits: a row a vertex and task is shuffled, not a row an edge."""

        none, there = F.lit(0).cast("long"), F.lit(1)
        every = self.vertices.select("vid", there.alias("is"), none.alias("v"), none.alias("o"), none.alias("i"))
        every = every.unionAll(self.vlabels.select("vid", there - 1, label_bit(F.col("vl"), vls), none, none))
        every = every.unionAll(self.incidences.select("src", there - 1, none, label_bit(F.col("el"), els), none))
        every = every.unionAll(self.incidences.select("dst", there - 1, none, none, label_bit(F.col("el"), els)))
        own = every.groupBy("vid").agg(F.max("is").alias("is"), *[F.bit_or(c).alias(c) for c in "voi"]).where(F.col("is") == 1)

        return own.select("vid", labels_of("v", vls).alias("vls"), labels_of("o", els).alias("outs"), labels_of("i", els).alias("ins"))

    def having_vlabel(self, vids: DataFrame, vl: int) -> DataFrame:
        return vids.join(self.with_label(vl), "vid", "left_semi")

    def having_elabel(self, vids: DataFrame, el: int, out: bool = True) -> DataFrame:
        ends = self.incidences.where(F.col("el") == el).select(F.col("src" if out else "dst").alias("vid"))
        return vids.join(ends.distinct(), "vid", "left_semi")  # distinct in each task before any is sent

    def existing(self, pairs: DataFrame) -> DataFrame:
        """The (src, dst, el) rows that are edges."""
        return pairs.join(self.edges, ["src", "dst", "el"], "left_semi")

    def ranked_edges(self) -> DataFrame:
        """(el, i, src, dst): position of an edge in its label, from 0, by end points."""
        return ranked(self.edges, "el", ["src", "dst"])

    def ranked_vertices(self) -> DataFrame:
        """(vl, i, vid): position of a vertex in its label, from 0."""
        return ranked(self.vlabels, "vl", ["vid"])

    def ranked_adjacency(self, out: bool = True) -> DataFrame:
        """(vid, el, i, other, deg): neighbours by position, in no particular order, for random steps."""
        a, b = ("src", "dst") if out else ("dst", "src")
        e = self.edges.select(F.col(a).alias("vid"), "el", F.col(b).alias("other"))
        return placed(e, ["vid", "el"]).withColumnsRenamed({"_i": "i", "_n": "deg"})


#: Labels of a kind that are held as bits of a long.
BITS = 62


def label_bit(label: F.Column, known: list[int]) -> F.Column:
    """The bit of a label among those known, 0 for any other."""
    return F.coalesce(*[F.when(label == x, F.lit(1 << i)) for i, x in enumerate(known)], F.lit(0)).cast("long")


def labels_of(bits: str, known: list[int]) -> F.Column:
    """The known labels whose bits are set, as an array."""
    some = [F.when(F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(x)) for i, x in enumerate(known)]
    return F.array_compact(F.array(*some)).cast("array<int>") if some else F.array().cast("array<int>")


#: Rows of a task that holds them in memory, whatever the size of the whole.
TASK_ROWS = 1 << 19


def tasks(spark: SparkSession, rows: float) -> int:
    """Number of tasks over so many rows; the session's number of shuffle partitions may not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -int(-rows // TASK_ROWS))


#: Parts in which a group's positions are counted, so that no group is one task's.
PARTS = 1024


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the position in its group of ``by`` (few groups) by ``order`` (longs), from 0.

    The range of the first column is cut into PARTS equal parts, ranked on their own and
    offset by the rows of the parts before.
    """
    span = rows.groupBy(by).agg(F.min(order[0]).alias("_lo"), F.max(order[0]).alias("_hi"))  # one row a group
    part = F.floor((F.col(order[0]) - F.col("_lo")) / F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1) / F.lit(float(PARTS)))).cast("int")
    rows = rows.join(F.broadcast(span), by).withColumn("_b", part).drop("_lo", "_hi")
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_c")).select(by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_f"))  # PARTS rows a group at most
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order)) - 1)
    return rows.join(F.broadcast(parts), [by, "_b"]).withColumn("i", F.col("_r") + F.col("_f")).drop("_b", "_r", "_f")


def ranked_within(rows: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """``rows`` with ``i``, the position in its group of ``by`` (many groups) by ``order`` (a long, distinct within a group), from 0.

    The range that ``order`` has under each ``label`` (one of ``by``, few values) is cut into
    PARTS; a group is ranked part by part, so a hub is no single task's.
    """
    span = rows.groupBy(label).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))  # one row a label
    part = F.floor((F.col(order) - F.col("_lo")) / F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1) / F.lit(float(PARTS)))).cast("int")
    rows = rows.join(F.broadcast(span), label).withColumn("_b", part).drop("_lo", "_hi")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order)) - 1)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")).select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_f"))
    return rows.join(parts, [*by, "_b"]).withColumn("i", F.col("_r") + F.col("_f")).drop("_b", "_r", "_f")


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (distinct) with a position ``_i`` from 0 and the count ``_n`` within ``by``; a hub is ranked in PARTS parts."""
    every = rows.columns
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*every), F.lit(PARTS)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*every)) - 1)
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.select(*by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_f"), F.sum("_c").over(whole).alias("_n"))
    return rows.join(parts, [*by, "_b"]).withColumn("_i", F.col("_r") + F.col("_f")).drop("_b", "_r", "_f")
