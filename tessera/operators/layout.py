"""Writing a table as advised: a folder a day or hour, ranges of the clustering columns as files, sorted inside.

Rows are dealt to tasks by sampled ranges of partition and clustering columns together, so a day of very many rows is
split over tasks and a task writes few days. What a query on clustering columns has to open shows in the files' footers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.footers import column_ranges

ROWS_A_FILE = 2_000_000


def partition_column(partitioning: dict, columns: list[str]) -> tuple[str, Column] | None:
    """Name and value of the column that folders are made by; none where nothing is advised.

    A time column gets a derived column of its day or hour, ingestion time the day of writing.
    """
    column, hourly = partitioning.get("column"), partitioning.get("granularity") == "HOUR"
    if partitioning.get("strategy") == "INGESTION_TIME":
        return "_partition_date", F.current_date()
    if partitioning.get("strategy") != "COLUMN" or not column:
        return None
    if column not in columns:
        raise ValueError(f"there is no column {column} to partition by")
    if partitioning.get("column_type") == "DATE":
        return column, F.col(f"`{column}`")
    value = F.date_format(f"`{column}`", "yyyy-MM-dd-HH") if hourly else F.to_date(f"`{column}`")
    return f"{column}_{'hour' if hourly else 'date'}", value


def write_laid_out(df: DataFrame, path: str, partitioning: dict | None = None, clustering: list[str] | tuple[str, ...] = (), files: int | None = None) -> None:
    """Write ``df`` as Parquet; ``files`` is about how many there are in all, else it follows the rows.

    Null times lie in a folder of their own. Without advice rows are written as they lie.
    """
    if unknown := [c for c in clustering if c not in df.columns]:
        raise ValueError("there is no column to cluster by: " + ", ".join(unknown))
    by = partition_column(partitioning or {}, df.columns)
    rows = df.withColumn(by[0], by[1]) if by else df
    order = ([by[0]] if by else []) + list(clustering)
    if order:
        n = files or max(1, -(-df.count() // ROWS_A_FILE))
        rows = rows.repartitionByRange(n, *(f"`{c}`" for c in order)).sortWithinPartitions(*(f"`{c}`" for c in order))
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(by[0]) if by else writer).parquet(path)


def ranges(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(file, rows, least, most)``: what each file's footer says of a column; files that hold no value have nulls."""
    return column_ranges(spark, path, column)


def must_open(found: DataFrame, low, high) -> DataFrame:
    """Files of :func:`ranges` that may hold a value from ``low`` to ``high``, as texts of numbers or dates compare in their column's order."""
    return found.where((F.col("least") <= F.lit(high)) & (F.col("most") >= F.lit(low)))
