"""Small text files (patterns, results) on any store that Spark reads."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(where)


def read_texts(spark: SparkSession, path: str, ending: str) -> dict[str, str]:
    """The whole text of a file by its name, or of every file below a folder with the ending by its path there, in order.

    Meant for patterns, which planning needs on the driver: what is read must be small.
    """
    files, where = _at(spark, path)
    reader, root = spark.read, where.toUri().getPath()
    folder = files.getFileStatus(where).isDirectory()
    if folder:
        listed = files.listFiles(where, True)
        if not any(listed.next().getPath().getName().endswith(ending) for _ in iter(listed.hasNext, False)):
            return {}
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}")
    found = reader.text(where.toString(), wholetext=True).select("_metadata.file_path", "value").collect()
    named = {unquote(urlsplit(r["file_path"]).path): r["value"] for r in found}
    return {p[len(root) :].lstrip("/") if folder else p.rsplit("/", 1)[-1]: named[p] for p in sorted(named)}


def write_text(spark: SparkSession, path: str, said: str) -> None:
    """Write one text file, over what was there; its folders are made."""
    files, where = _at(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(said, "utf-8"))
    finally:
        out.close()
