"""The star schema as a graph: entities are vertices, foreign keys are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, tasks

#: Distance between the id ranges of two kinds: a kind's keys may reach 2**56.
KIND = 1 << 56
ENTITIES = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))
#: edge label -> table, source kind and key, destination kind and key, whether keys repeat.
EDGES = (
    ("nation", 1, "n_nationkey", 0, "n_regionkey", False), ("customer", 2, "c_custkey", 1, "c_nationkey", False), ("supplier", 3, "s_suppkey", 1, "s_nationkey", False),
    ("orders", 5, "o_orderkey", 2, "o_custkey", False), ("lineitem", 5, "l_orderkey", 4, "l_partkey", True), ("lineitem", 5, "l_orderkey", 3, "l_suppkey", True), ("lineitem", 4, "l_partkey", 3, "l_suppkey", True),
)
STATUS, SEGMENTS = ("F", "O", "P"), ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Labels 0-5 are the entities, 6-8 order status, 9-13 market segments in alphabetical order."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def vid(kind: int, key: str) -> F.Column:
        return F.col(key).cast("long") + F.lit(kind * KIND).cast("long")

    labels = [table(t).select(vid(k, key).alias("vid"), F.lit(k).alias("vl")) for k, (t, key) in enumerate(ENTITIES)]
    status = F.create_map(*[x for i, s in enumerate(STATUS) for x in (F.lit(s), F.lit(6 + i))])
    segment = F.create_map(*[x for i, s in enumerate(SEGMENTS) for x in (F.lit(s), F.lit(9 + i))])
    labels.append(table("orders").select(vid(5, "o_orderkey").alias("vid"), status[F.col("o_orderstatus")].alias("vl")).where("vl is not null"))
    labels.append(table("customer").select(vid(2, "c_custkey").alias("vid"), segment[F.col("c_mktsegment")].alias("vl")).where("vl is not null"))
    edges, every = [], []
    n = tasks(spark, table("lineitem").count())  # the one table whose keys repeat; its footers say it
    for el, (t, ks, src, kd, dst, repeats) in enumerate(EDGES):
        e = table(t).select(vid(ks, src).alias("src"), vid(kd, dst).alias("dst")).where("src is not null and dst is not null")
        # Hardly any pair repeats within a read split, so none is looked for before the shuffle; joins and degrees by source need no other.
        edges.append((e.repartition(n, "src").distinct() if repeats else e).withColumn("el", F.lit(el)))
        every.append(e.withColumn("el", F.lit(el)))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return Graph(union([x.select("vid") for x in labels[:6]]), union(labels), union(edges), apart=True, repeated=union(every))


def star_sql() -> str:
    """The same graph as SQL common table expressions ``vlabels`` and ``edges``."""
    labels = [f"SELECT {key}::BIGINT + {k * KIND} AS vid, {k} AS vl FROM {t}" for k, (t, key) in enumerate(ENTITIES)]
    labels += [f"SELECT o_orderkey::BIGINT + {5 * KIND}, {6 + i} FROM orders WHERE o_orderstatus = '{s}'" for i, s in enumerate(STATUS)]
    labels += [f"SELECT c_custkey::BIGINT + {2 * KIND}, {9 + i} FROM customer WHERE c_mktsegment = '{s}'" for i, s in enumerate(SEGMENTS)]
    edges = [f"SELECT DISTINCT {s}::BIGINT + {ks * KIND} AS src, {d}::BIGINT + {kd * KIND} AS dst, {el} AS el FROM {t}" for el, (t, ks, s, kd, d, _) in enumerate(EDGES)]
    return f"WITH RECURSIVE vlabels AS ({' UNION ALL '.join(labels)}), edges AS ({' UNION ALL '.join(edges)})"
