"""Shared folders, staged tables and small helpers used by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session names none, one is made and set in local mode; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def limit_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most ``rows`` rows be at once between Spark and Python, in this session from now on: texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a recomputation), and gives
    the reader a plain scan, which adaptive execution can split when a join key is hot.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    limit_batches(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame | None) -> None:
    """Delete tables written by :func:`stage` that no later step reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def broadcast_if_small(staged: DataFrame, items: Column | None = None, most: int = 500_000) -> DataFrame:
    """A staged table of fixed-width columns, to be broadcast where it has at most ``most`` rows.

    ``items`` counts the entries of a row's list, which then count as well. Beyond that it is joined by a shuffle.
    """
    held = F.count(F.lit(1)) if items is None else F.count(F.lit(1)) + F.coalesce(F.sum(items), F.lit(0))
    return F.broadcast(staged) if staged.agg(held).first()[0] <= most else staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_ranks(ids: DataFrame, key: str, name: str) -> DataFrame | None:
    """``(key, name)``: for ids that are not whole numbers, a long that grows with them, by a range sort; null for whole numbers."""
    if isinstance(ids.schema[key].dataType, T.IntegralType):
        return None
    # Numbers of a task are larger than those of the tasks before it.
    return stage(ids.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn(name, F.monotonically_increasing_id()), "id-ranks")


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Note that a worker keeps tables of this name from task to task, and how it drops them."""
    _held[name] = drop


def let_go(keep: str | None = None) -> None:
    """Drop tables that tasks of other operators left in this worker, which stays for all of them."""
    others = [name for name in _held if name != keep]
    for name in others:
        _held.pop(name)()
    if others:
        release()


def pieces(batches, rows: int = 256, keep: str | None = None):
    """Arrow batches in slices of few rows, so that what is made of one is given on before the next.

    Of the tables that the worker holds, those named ``keep`` stay.
    """
    let_go(keep)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give back to the system what a task no longer uses, since its Python worker stays for others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def values(column):
    """The Python values of an Arrow column, one at a time, so that a batch is not held twice."""
    return (x.as_py() for x in column)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
