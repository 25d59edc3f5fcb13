"""What the operators share: the shared folder, written tables, hashing constants."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words in every contract.
BLANKS = " \t\n\x0b\f\r"
#: A Mersenne prime: products of two residues stay below 2**62, so ANSI arithmetic holds.
P31 = 2147483647
#: Numbers of one bitmap, and bytes of bitmaps that are broadcast at most.
BLOCK = 1 << 15
BITMAP_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a machine's own only where none is named and all tasks run in this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphtally-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/graphtally/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: evaluated once, lineage cut."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished phases now, not whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose long ``column`` is in the column of that name of ``ids``, a written table.

    The numbers go to the rows as bitmaps, exact and about a bit each where they are dense,
    so rows are not shuffled; above ``BITMAP_BYTES`` rows and numbers meet in a shuffle.
    """
    block, bit = F.shiftright(column, BLOCK.bit_length() - 1).alias("_block"), F.pmod(column, F.lit(BLOCK)).cast("long")
    bits = written(ids.groupBy(block).agg(F.bitmap_construct_agg(bit).alias("_bits")), "bitmaps")
    if bits.count() * (BLOCK // 8) > BITMAP_BYTES:
        drop_written(df.sparkSession, bits)
        return df.join(ids, column, "left_semi")
    octet = F.conv(F.hex(F.substr("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(octet, (bit % 8).cast("int")) == 1
    return df.select("*", block).join(F.broadcast(bits), "_block").where(held).select(*df.columns)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words_of(text: Column) -> Column:
    """Words between ASCII blanks."""
    return F.size(words_of(text)).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words between ASCII blanks; empty for a text of blanks."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))
