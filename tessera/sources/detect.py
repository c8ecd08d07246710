"""Which reader a path needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

FORMATS = {"csv": "csv", "avro": "avro", "parquet": "parquet", "json": "json", "jsonl": "json"}


def detect_format(spark: SparkSession, path: str) -> str:
    """The format by extension, for a path on any file system that Spark opens."""
    if not path or not path.strip():
        raise ValueError("the path is empty")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jpath):
        raise FileNotFoundError(path)
    if files.getContentSummary(jpath).getLength() == 0:
        raise ValueError(f"{path} is empty")
    extension = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
    if not extension[1]:
        raise ValueError(f"{path} has no extension")
    kind = FORMATS.get(extension[2].lower())
    if kind is None:
        raise ValueError(f"{path}: no reader for .{extension[2]}")
    return kind
