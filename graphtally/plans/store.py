"""Tables that are built once, written, and read by whoever asks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Named tables in one folder. A table counts as there once its writer has committed it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def scratch(cls, spark: SparkSession) -> Store:
        """A fresh folder that all executors share, deleted when the session's JVM ends."""
        sc = spark.sparkContext
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not named:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="graphtally-")
            sc.setCheckpointDir(named)
        out = cls(spark, f"{named.rstrip('/')}/graphtally/{uuid.uuid4().hex}")
        where, files = out._file("")
        files.deleteOnExit(where)
        return out

    def _file(self, name: str):  # noqa: ANN202
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        """Whether the table was written to its end; a half-written folder has no mark of success."""
        where, files = self._file(f"{name}/_SUCCESS")
        return bool(files.exists(where))

    def size(self, name: str = "") -> int:
        """Bytes of a table, or of all."""
        where, files = self._file(name)
        return int(files.getContentSummary(where).getLength()) if files.exists(where) else 0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def save(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """The table ``name``, built from ``df`` unless it is there."""
        if not self.has(name):
            writer = df.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        return self.table(name)
