"""Fields as rows: declared and inferred columns, target types, descriptions, metadata columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.profile import counts, profile, with_precision
from tessera.standards import METADATA_COLUMNS, METADATA_NAMES

FIELD_SCHEMA = (
    "entity string, ord int, path string, depth int, name string, raw_name string, data_type string, is_array boolean, nullable boolean, "
    "description string, precision int, scale int"
)


def canonical_type(kind: T.DataType) -> str:
    """The canonical type of a Spark type; what has none is STRING."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    named = {T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.DecimalType: "DECIMAL", T.StructType: "RECORD", T.MapType: "JSON", T.VariantType: "JSON"}
    return next((name for cls, name in named.items() if isinstance(kind, cls)), "STRING")


def declared_rows(entity: str, schema: T.StructType) -> list[tuple]:
    """Rows of FIELD_SCHEMA for a schema, parents before children; nested lists count as one."""
    out: list[tuple] = []

    def walk(struct: T.StructType, prefix: str, depth: int) -> None:
        for field in struct.fields:
            kind, repeated = field.dataType, False
            while isinstance(kind, T.ArrayType):
                kind, repeated = kind.elementType, True
            decimal = isinstance(kind, T.DecimalType)
            out.append((
                entity, len(out), f"{prefix}{field.name}", depth, field.name, field.name, canonical_type(kind), repeated, field.nullable,
                field.metadata.get("comment") or field.metadata.get("description"), kind.precision if decimal else None, kind.scale if decimal else None,
            ))
            if isinstance(kind, T.StructType):
                walk(kind, f"{prefix}{field.name}.", depth + 1)

    walk(schema, "", 1)
    return out


def declared_fields(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([r for name, df in tables.items() for r in declared_rows(name, df.schema)], FIELD_SCHEMA)


def with_stats(fields: DataFrame, tables: dict[str, DataFrame], error: float | None = None) -> DataFrame:
    """``fields`` with the counts and ratios of each top-level column of its table, exact or to an ``error``."""
    stats = None
    for name, df in tables.items():
        flat = df.select(*(F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) if isinstance(df.schema[c].dataType, T.VariantType) else F.col(f"`{c}`") for c in df.columns))
        one = counts(flat, error=error).select(F.lit(name).alias("entity"), F.col("name").alias("path"), F.col("n").alias("row_count"), "distinct_ratio", "null_ratio")
        stats = one if stats is None else stats.unionByName(one)
    return fields.join(stats, ["entity", "path"], "left")


def inferred_fields(entity: str, df: DataFrame) -> DataFrame:
    """Fields of a table of text, with the types its values support."""
    found = with_precision(profile(df))
    return found.select(
        F.lit(entity).alias("entity"), "ord", F.col("name").alias("path"), F.lit(1).alias("depth"), "name", F.col("name").alias("raw_name"), "data_type",
        F.lit(False).alias("is_array"), "nullable", F.lit(None).cast("string").alias("description"), "precision", "scale",
        F.col("n").alias("row_count"), "distinct_ratio", "null_ratio", "max_length", "ambiguous_boolean",
    )


def target_type(data_type: Column, precision: Column, scale: Column) -> Column:
    """The warehouse type of a canonical type."""
    small = precision.isNull() | ((precision <= 38) & (scale <= 9))
    return (
        F.when(data_type == "DECIMAL", F.when(small, "NUMERIC").otherwise("BIGNUMERIC"))
        .when(data_type == "RANGE_DATE", "RANGE")
        .when(data_type.isin("INTEGER", "FLOAT", "BOOLEAN", "STRING", "DATE", "TIMESTAMP", "GEOGRAPHY", "JSON", "RECORD"), data_type)
        .otherwise("STRING")
    )


def target_mode(name: Column, is_array: Column) -> Column:
    """REPEATED for arrays, REQUIRED for metadata columns, else NULLABLE, whatever the data holds."""
    return F.when(is_array, "REPEATED").when(name.isin(*METADATA_NAMES), "REQUIRED").otherwise("NULLABLE")


def described(name: Column, data_type: Column) -> Column:
    words = F.lower(F.regexp_replace(name, "_", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30), F.lit(" stored as "), F.lower(data_type), F.lit(" value. Nullable field."))


def with_metadata_columns(fields: DataFrame) -> DataFrame:
    """``fields`` with the metadata columns that an entity lacks, after its own, and descriptions filled in."""
    spark = fields.sparkSession
    meta = spark.createDataFrame([(i, n, t, d) for i, (n, t, _, d) in enumerate(METADATA_COLUMNS)], "k int, name string, data_type string, description string")
    entities = fields.groupBy("entity").agg(F.max("ord").alias("last"), F.max("row_count").alias("row_count"))
    have = fields.where("depth = 1").select("entity", F.lower("name").alias("name"))
    added = entities.join(F.broadcast(meta)).join(have, ["entity", "name"], "left_anti").select(
        "entity", (F.col("last") + 1 + F.col("k")).cast("int").alias("ord"), F.col("name").alias("path"), F.lit(1).alias("depth"), "name",
        F.col("name").alias("raw_name"), "data_type", F.lit(False).alias("is_array"), F.lit(False).alias("nullable"), "description", "row_count",
    )
    out = fields.unionByName(added, allowMissingColumns=True)
    return out.withColumn("description", F.coalesce("description", F.when(F.col("depth") == 1, described(F.col("name"), F.col("data_type")))))


def with_targets(fields: DataFrame) -> DataFrame:
    """``fields`` with the warehouse type and mode of each."""
    return fields.withColumns({
        "bq_type": target_type(F.col("data_type"), F.col("precision"), F.col("scale")), "mode": target_mode(F.col("name"), F.col("is_array")),
        "range_element": F.when(F.col("data_type") == "RANGE_DATE", "DATE"),
    })


def source_errors(fields: DataFrame) -> DataFrame:
    """``(entity, error)`` of entities without fields of their own, or with a reserved metadata name."""
    top = fields.where("depth = 1")
    reserved = F.lower("raw_name").isin(*METADATA_NAMES)
    found = top.groupBy("entity").agg(F.count_if(~reserved).alias("own"), F.array_sort(F.collect_set(F.when(reserved, F.col("raw_name")))).alias("reserved"))
    return found.select("entity", F.when(F.col("own") == 0, "only metadata columns").when(F.size("reserved") > 0, F.concat(F.lit("reserved column names: "), F.array_join("reserved", ", "))).alias("error")).where("error is not null")


def add_metadata(df: DataFrame, source_system: str, batch_id: str, at: Column | None = None, op_type: str = "INSERT") -> DataFrame:
    """Rows with the metadata columns filled in; columns that are there already stay as they are.

    The record hash is the SHA-256 of the row's columns as text, nulls as the empty string, joined by U+001F.
    """
    at = F.current_timestamp() if at is None else at
    body = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))
    values = {
        "_ingestion_timestamp": at, "_source_system": F.lit(source_system), "_batch_id": F.lit(batch_id), "_record_hash": F.sha2(body, 256), "_is_deleted": F.lit(False),
        "_deleted_timestamp": F.lit(None).cast("timestamp"), "_op_type": F.lit(op_type), "_op_ts": at,
    }
    have = {c.lower() for c in df.columns}
    return df.withColumns({name: values[name] for name in METADATA_NAMES if name not in have})
