"""Identifier rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import strip
from tessera.standards import RESERVED_WORDS


def normalized(name: Column) -> Column:
    """Lower-case words joined by underscores; never empty, never starting with a digit."""
    parts = F.regexp_replace(strip(name), r"([a-z0-9])([A-Z])", "$1_$2")
    plain = F.regexp_replace(F.regexp_replace(F.lower(parts), r"[^a-z0-9_]", "_"), r"_+", "_")
    trimmed = F.regexp_replace(plain, r"^_+|_+$", "")
    return F.when(trimmed.rlike(r"^[a-z]"), trimmed).otherwise(F.concat(F.lit("_"), trimmed))


def dataset_name(domain: Column, environment: Column, zone: Column) -> Column:
    return normalized(F.concat_ws("_", domain, environment, zone))


def table_name(domain: Column, entity: Column, layer: Column) -> Column:
    return normalized(F.concat_ws("_", domain, entity, layer))


def with_final_names(fields: DataFrame, entity: str = "entity", ordinal: str = "ord", raw: str = "raw_name", table: str = "table_name") -> DataFrame:
    """``fields`` with ``final_name``: normalised, reserved words prefixed by the table, repeats numbered from 2.

    The numbering is by (entity, name), so that no task needs a whole entity.
    """
    base = normalized(F.col(raw))
    safe = F.when(base.isin(*RESERVED_WORDS), F.concat_ws("_", F.col(table), base)).otherwise(base)
    order = Window.partitionBy(entity, "__base").orderBy(ordinal)
    numbered = fields.withColumn("__base", safe).withColumn("__n", F.row_number().over(order))
    final = F.when(F.col("__n") > 1, F.concat_ws("_", F.col("__base"), F.col("__n").cast("string"))).otherwise(F.col("__base"))
    return numbered.withColumn("final_name", final).drop("__base", "__n")
