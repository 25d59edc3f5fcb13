"""Graph files: the line format in and out, and Parquet as the native layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.store import Store


def read_text(spark: SparkSession, path: str, dedup: bool = True) -> Graph:
    """``v id label*`` and ``e src dst label+`` lines; negative labels are none, edges are a set unless ``dedup`` is off.

    With ``dedup`` off repeated edges stay and only the first label of an edge line counts.
    """
    t = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("t"))
    kind = F.get("t", F.lit(0))
    v = t.where(kind == "v").select(F.get("t", F.lit(1)).cast("long").alias("vid"), F.slice("t", 3, 1 << 30).alias("ls"))
    labels = v.select("vid", F.explode(F.col("ls").cast("array<int>")).alias("vl")).where("vl >= 0")
    several = F.slice("t", 4, 1 << 30 if dedup else 1)
    e = t.where(kind == "e").select(F.get("t", F.lit(1)).cast("long").alias("src"), F.get("t", F.lit(2)).cast("long").alias("dst"), F.explode(several.cast("array<int>")).alias("el"))
    e = e.where("el >= 0")
    return Graph(v.select("vid"), labels.distinct() if dedup else labels, e.distinct() if dedup else e)


def text_lines(g: Graph) -> DataFrame:
    """The graph as lines (kind order, then id). Lines are made after the sort, which moves ids only."""
    labels = g.vlabels.groupBy("vid").agg(F.sort_array(F.collect_list("vl")).alias("ls"))
    v = g.vertices.join(labels, "vid", "left").select(F.lit(0).alias("k"), F.col("vid").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("int").alias("c"), "ls")
    e = g.edges.select(F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("el").alias("c"), F.lit(None).cast("array<int>").alias("ls"))
    rows = v.unionByName(e).orderBy("k", "a", F.col("b").asc_nulls_first(), "c")
    line = F.when(F.col("k") == 0, F.concat_ws(" ", F.lit("v"), "a", F.col("ls").cast("array<string>"))).otherwise(F.concat_ws(" ", F.lit("e"), "a", "b", "c"))
    return rows.select(line.alias("value"))


def write_parquet(g: Graph, path: str) -> None:
    """Edges by label, sorted by end points: a label's relation is one directory. Tables that are there to their end stay."""
    g.stored(Store(g.edges.sparkSession, path))


def read_parquet(spark: SparkSession, path: str) -> Graph:
    store = Store(spark, path)
    return Graph(store.table("vertices"), store.table("vlabels"), store.table("edges").select("src", "dst", "el"))


def built(spark: SparkSession, path: str) -> bool:
    """Whether a graph was written there to its end."""
    return all(Store(spark, path).has(t) for t in ("vertices", "vlabels", "edges"))
