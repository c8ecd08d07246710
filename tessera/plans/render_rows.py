"""The text forms of schemas: warehouse and Spark DDL, migrations, JSON and documentation lines, for many entities at once.

Fields are rows by path; records are folded into their columns from the deepest level up, so nested lists of records render
like flat columns. An entity's columns are gathered to one text, of which the rule for column counts allows ten thousand.
The wording of statements is fixed, since it has to match what others parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.nesting import fold, joined

# Types of Spark's dialect where they differ from the warehouse's.
SPARK_TYPES = {"INTEGER": "BIGINT", "FLOAT": "DOUBLE", "NUMERIC": "DECIMAL(38,9)", "BIGNUMERIC": "DECIMAL(38,18)", "DATETIME": "TIMESTAMP_NTZ", "JSON": "VARIANT", "GEOGRAPHY": "STRING", "RANGE": "STRUCT<start: DATE, end: DATE>"}
BUCKETS = 64


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _said(description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(' OPTIONS(description="'), _quoted(description), F.lit('")'))).otherwise("")


def _literal(text: Column) -> Column:
    """A text between single quotes."""
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _struct(children: Column, text: str) -> Column:
    """What is inside a record; one without fields has no text form."""
    inner = F.concat(F.lit("STRUCT<"), joined(children, text, ", "), F.lit(">"))
    return F.when(F.size(children) > 0, inner).otherwise(F.raise_error(F.concat(F.lit("record "), F.col("name"), F.lit(" has no fields"))))


def _listed(kind: Column) -> Column:
    return F.when(F.col("mode") == "REPEATED", F.concat(F.lit("ARRAY<"), kind, F.lit(">"))).otherwise(kind)


def _ddl(children: Column) -> Column:
    """A column of the warehouse dialect; nested ones are never NOT NULL."""
    kind = F.when(F.col("bq_type") == "RECORD", _struct(children, "ddl")).when(F.col("bq_type") == "RANGE", F.concat(F.lit("RANGE<"), F.coalesce("range_element", F.lit("DATE")), F.lit(">"))).otherwise(F.col("bq_type"))
    required = F.when((F.col("mode") == "REQUIRED") & (F.col("depth") == 1), " NOT NULL").otherwise("")
    return F.concat(F.lit("`"), "name", F.lit("` "), _listed(kind), required, _said(F.col("description")))


def _spark(children: Column) -> Column:
    """A column of Spark's dialect; inside a record it is a name and a type."""
    kind = F.when(F.col("bq_type") == "RECORD", _struct(children, "spark"))
    for name, own in SPARK_TYPES.items():
        kind = kind.when(F.col("bq_type") == name, own)
    whole = _listed(kind.otherwise(F.col("bq_type")))
    required = F.when(F.col("mode") == "REQUIRED", " NOT NULL").otherwise("")
    said = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" COMMENT "), _literal(F.col("description")))).otherwise("")
    return F.when(F.col("depth") == 1, F.concat(F.lit("`"), "name", F.lit("` "), whole, required, said)).otherwise(F.concat(F.lit("`"), "name", F.lit("`: "), whole))


def _json(children: Column) -> Column:
    """A column as an object of the JSON schema; what it does not have is left out."""
    own = F.to_json(F.struct("name", F.col("bq_type").alias("type"), "mode", F.nullif("description", F.lit("")).alias("description")))
    more = F.concat(
        F.when((F.col("bq_type") == "RECORD") & (F.size(children) > 0), F.concat(F.lit(',"fields":['), joined(children, "json", ","), F.lit("]"))).otherwise(""),
        F.when((F.col("bq_type") == "RANGE") & F.col("range_element").isNotNull(), F.concat(F.lit(',"rangeElementType":{"type":"'), "range_element", F.lit('"}'))).otherwise(""),
    )
    return F.concat(F.substring(own, F.lit(1), F.length(own) - 1), more, F.lit("}"))


TEXTS = {"ddl": _ddl, "spark": _spark, "json": _json}


def column_texts(fields: DataFrame, texts: tuple[str, ...] = ("ddl", "spark", "json"), deepest: int | None = None) -> DataFrame:
    """Top-level rows of fields with targets and the named texts of each column, nested ones inside."""
    if "range_element" not in fields.columns:
        fields = fields.withColumn("range_element", F.lit(None).cast("string"))
    return fold(fields, {t: TEXTS[t] for t in texts}, deepest=deepest)


def _in_order(column: str, order: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), between)


def _clusters(clustering: DataFrame) -> DataFrame:
    return clustering.select("entity", "rank", F.concat(F.lit("`"), "column", F.lit("`")).alias("quoted")).groupBy("entity").agg(_in_order("quoted", "rank", ", ").alias("clusters"))


def create_tables(fields: DataFrame, names: DataFrame, partitioning: DataFrame, clustering: DataFrame, deepest: int | None = None) -> DataFrame:
    """``(entity, ddl)``. ``names`` has ``(entity, dataset, table, description)``; time columns partition by day."""
    columns = column_texts(fields, ("ddl",), deepest).groupBy("entity").agg(_in_order("ddl", "ord", ",\n  ").alias("columns"))
    rows = columns.join(names, "entity").join(partitioning.select("entity", "strategy", "column", "column_type"), "entity", "left").join(_clusters(clustering), "entity", "left")
    column = F.concat(F.lit("`"), "column", F.lit("`"))
    by = F.when(F.col("strategy") == "INGESTION_TIME", "\nPARTITION BY _PARTITIONTIME").when(F.col("column_type") == "DATE", F.concat(F.lit("\nPARTITION BY "), column)).when(
        F.col("column_type").isin("TIMESTAMP", "DATETIME"), F.concat(F.lit("\nPARTITION BY DATE("), column, F.lit(")")),
    )
    by = F.coalesce(by, F.lit(""))
    options = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit('\nOPTIONS(\n  description="'), _quoted(F.col("description")), F.lit('"\n)'))).otherwise("")
    ddl = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS `"), "dataset", F.lit("."), "table", F.lit("` (\n  "), "columns", F.lit("\n)"), by,
        F.when(F.col("clusters").isNotNull(), F.concat(F.lit("\nCLUSTER BY "), "clusters")).otherwise(""), options, F.lit(";"),
    )
    return rows.select("entity", ddl.alias("ddl"))


def create_spark_tables(fields: DataFrame, names: DataFrame, partitioning: DataFrame, clustering: DataFrame, deepest: int | None = None) -> DataFrame:
    """``(entity, ddl)`` for Spark over Parquet: a partitioning time column gets a derived date column, clustering columns become sorted buckets."""
    columns = column_texts(fields, ("spark",), deepest).groupBy("entity").agg(_in_order("spark", "ord", ",\n  ").alias("columns"))
    rows = columns.join(names, "entity").join(partitioning.select("entity", "column", "column_type"), "entity", "left").join(_clusters(clustering), "entity", "left")
    derived = F.col("column").isNotNull() & (F.col("column_type") != "DATE")
    day = F.when(derived, F.concat(F.col("column"), F.lit("_date"))).otherwise(F.col("column"))
    ddl = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS `"), "dataset", F.lit("`.`"), "table", F.lit("` (\n  "), "columns",
        F.when(derived, F.concat(F.lit(",\n  `"), day, F.lit("` DATE COMMENT 'Day of "), "column", F.lit(", for partitioning'"))).otherwise(""), F.lit("\n) USING parquet"),
        F.when(F.col("column").isNotNull(), F.concat(F.lit("\nPARTITIONED BY (`"), day, F.lit("`)"))).otherwise(""),
        F.when(F.col("clusters").isNotNull(), F.concat(F.lit("\nCLUSTERED BY ("), "clusters", F.lit(") SORTED BY ("), "clusters", F.lit(f") INTO {BUCKETS} BUCKETS"))).otherwise(""),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\nCOMMENT "), _literal(F.col("description")))).otherwise(""), F.lit(";"),
    )
    return rows.select("entity", ddl.alias("ddl"))


def create_schemas(names: DataFrame, location: str = "US") -> DataFrame:
    """``(dataset, ddl)`` of each dataset."""
    return names.select("dataset").distinct().select("dataset", F.concat(F.lit("CREATE SCHEMA IF NOT EXISTS `"), "dataset", F.lit(f"`\nOPTIONS(location='{location}');")).alias("ddl"))


def migrations(changes: DataFrame, names: DataFrame) -> DataFrame:
    """``(entity, name, statement, refused)``: ALTER TABLE for each added column; only nullable ones can be added, others say why not."""
    rows = changes.where("change = 'ADD_NULLABLE_COLUMN'").join(names.select("entity", "dataset", "table"), "entity")
    mode = F.coalesce("new_mode", F.lit("NULLABLE"))
    text = F.concat(F.lit("ALTER TABLE `"), "dataset", F.lit("."), "table", F.lit("` ADD COLUMN `"), "name", F.lit("` "), "new_type", _said(F.col("new_description")), F.lit(";"))
    why = F.when(mode != "NULLABLE", F.concat("name", F.lit(" is "), mode, F.lit("; only a nullable column can be added")))
    return rows.select("entity", "name", F.when(why.isNull(), text).alias("statement"), why.alias("refused"))


def column_docs(fields: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """``(entity, ord, section, line)``: the rows of the documentation's column tables; nested fields follow theirs, by path."""
    said = F.replace(F.coalesce("description", F.lit("")), F.lit("|"), F.lit("\\|"))
    name = F.coalesce("path", "name") if "path" in fields.columns else F.col("name")
    line = F.concat(F.lit("| "), name, F.lit(" | "), "bq_type", F.lit(" | "), "mode", F.lit(" | "), said, F.lit(" |"))
    own = F.when((F.col("depth") == 1) & F.col("name").isin(*system), "System / Metadata Columns").otherwise("Business Columns")
    return fields.select("entity", "ord", own.alias("section"), line.alias("line"))


def column_json(fields: DataFrame, deepest: int | None = None) -> DataFrame:
    """``(entity, ord, json)``: each column as an object of the JSON schema."""
    return column_texts(fields, ("json",), deepest).select("entity", "ord", "json")
