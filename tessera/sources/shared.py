"""Folders that driver and executors share, for files that a source rewrites."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``; in local mode, where none is named, under a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, tag: str) -> DataFrame:
    """Few rows, made once and kept in the shared folder, so that no later step reads again what they come from."""
    path = shared_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
