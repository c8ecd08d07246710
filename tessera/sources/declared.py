"""Parquet and Avro, whose files declare their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.footers import fields_of


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parquet_fields(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Declared fields with descriptions, and the row count; of each file the footer alone is read, in tasks."""
    return fields_of(spark, path, entity, "parquet")[0]


def avro_fields(spark: SparkSession, path: str, entity: str) -> tuple[DataFrame, str | None]:
    """Declared fields with the exact row count, and the description of the records; of each file the heads alone are read, in tasks."""
    return fields_of(spark, path, entity, "avro")
