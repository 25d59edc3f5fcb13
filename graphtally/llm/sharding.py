"""Sharding by a keyed permutation of global row numbers.

Every row gets a global number, a Feistel network over ``Z_a x Z_b`` (a*b just over
the row count) with cycle walking permutes the numbers, and the permuted number gives
shard and slot by division.  Anyone who knows the row count and the seed can compute
where row r lies, and which row lies in a slot (the network runs backwards too).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P31, text_of, written

#: Row-number buckets: a constant, so the table of their offsets stays small.
BUCKETS = 8192
ROUNDS = 6
#: Identical rows are numbered as one run; a run unfolds in pieces of this many.
RUN = 4096
#: Walk steps tried first. A walk passes each of the a*b-n points beyond the range once at
#: most, so the few rows still out of range then walk up to that many steps, which is exact.
WALK = 16


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three residues per round from a linear congruence on the seed."""
    state, keys = (seed * 2654435761 + 97) % P31, []
    for _ in range(rounds):
        three = []
        for _ in range(3):
            state = (state * 48271 + 11) % P31
            three.append(state or 1)
        keys.append(tuple(three))
    return keys


def domain(n: int) -> tuple[int, int]:
    """The smallest near-square grid with at least n cells."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _noise(x: Column, key: tuple[int, int, int]) -> Column:
    y = (x * F.lit(key[0]) + F.lit(key[1])) % F.lit(P31)
    return (y * y + F.lit(key[2])) % F.lit(P31)


def permuted(df: DataFrame, number: str, out: str, n: int, seed: int) -> DataFrame:
    """Add ``out``, the permuted ``number``; both lie in 0..n-1."""
    a, b = domain(n)
    keys = round_keys(seed)
    df = df.withColumn("_l", F.expr(f"{number} div {b}L")).withColumn("_r", F.col(number) % F.lit(b))
    for i, key in enumerate(keys):
        if i % 2 == 0:
            df = df.withColumn("_l", (F.col("_l") + _noise(F.col("_r"), key)) % F.lit(a))
        else:
            df = df.withColumn("_r", (F.col("_r") + _noise(F.col("_l"), key)) % F.lit(b))
    df = df.withColumn("_p", F.col("_l") * F.lit(b) + F.col("_r"))

    rounds = F.array(*[F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip((*k, b if i % 2 else a), "xyzm", strict=True))) for i, k in enumerate(keys)])

    def step(p: Column) -> Column:
        # The halves swap each round, so one lambda serves odd and even rounds.
        start = F.struct(((p - p % F.lit(b)) / F.lit(b)).cast("long").alias("u"), (p % F.lit(b)).alias("v"))

        def turn(s: Column, k: Column) -> Column:
            y = (s["v"] * k["x"] + k["y"]) % F.lit(P31)
            return F.struct(s["v"].alias("u"), ((s["u"] + (y * y + k["z"]) % F.lit(P31)) % k["m"]).alias("v"))

        return F.aggregate(rounds, start, turn, lambda s: s["u"] * F.lit(b) + s["v"])

    for steps in (WALK, a * b - n):
        walked = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.col("_p"), lambda p, _: F.when(p < n, p).otherwise(step(p)))
        df = df.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(walked))
    checked = F.when(F.col("_p") < n, F.col("_p")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return df.withColumn(out, checked).drop("_l", "_r", "_p")


def _bucket(doc_id: Column, crc: Column) -> Column:
    mixed = (F.pmod(F.coalesce(doc_id, F.lit(-1)), F.lit(P31)) * F.lit(1103515245) + F.pmod(crc, F.lit(P31))) % F.lit(P31)
    return (mixed % F.lit(BUCKETS)).cast("int")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20240613) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard counts differ by one at most.  The global number of a row
    follows from its content (bucket of id and checksum, then id, size, checksum), so it
    does not depend on files or partitions; rows equal in all three are interchangeable
    and numbered as one run.  Null text counts as no bytes, null ids sort first, an
    empty table gives no rows, other columns are ignored.

    Only (id, size, checksum) ever moves; a third of all rows being one row, or sharing
    one id, moves as one counted row or spreads over the buckets by checksum.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
    )
    runs = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    runs = written(runs.withColumn("_bucket", _bucket(F.col("doc_id"), F.col("text_crc32"))), "row-runs")
    n = runs.agg(F.coalesce(F.sum("_n"), F.lit(0))).head()[0]

    in_order = Window.partitionBy("_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    offsets = runs.groupBy("_bucket").agg(F.sum("_n").alias("_all")).select("_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_from"))
    ranked = runs.withColumn("_at", F.coalesce(F.sum("_n").over(in_order), F.lit(0))).join(F.broadcast(offsets), "_bucket").withColumn("_at", F.col("_at") + F.col("_from"))

    few = ranked.where(F.col("_n") <= RUN).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = ranked.where(F.col("_n") > RUN).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {RUN}"))))
    many = many.repartition("_at", "_piece").withColumn("_k", F.explode(F.sequence(F.col("_piece") * RUN, F.least(F.col("_n"), (F.col("_piece") + 1) * RUN) - 1)))
    columns = ["doc_id", "size", "text_crc32", (F.col("_at") + F.col("_k")).alias("_row")]
    numbered = few.select(*columns).unionAll(many.select(*columns))

    if not n:
        placed = numbered.withColumn("_to", F.col("_row"))
    else:
        placed = permuted(numbered, "_row", "_to", n, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_to") % shards).cast("int").alias("shard"), F.expr(f"_to div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("_row").alias("row_number"),
    )
