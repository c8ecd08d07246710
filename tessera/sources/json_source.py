"""JSON and JSON lines: shape from variants that are merged over all records, types from the leaves' values."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.fields import FIELD_SCHEMA, declared_rows
from tessera.operators.profile import profile_cells, with_precision


def _without_strings(line: Column) -> Column:
    return F.regexp_replace(line, r'"(?:[^"\\]++|\\.)*+"', '""')


def renamed_keys(pairs: list[tuple], entity: str) -> dict:
    """An object whose repeated keys are numbered from 2; keys lose white space around them, blank ones are the entity's name and their place from 1."""
    out, seen = {}, {}
    for at, (key, value) in enumerate(pairs, 1):
        key = key.strip() or f"{entity}_{at}"
        seen[key] = seen.get(key, 0) + 1
        out[key if seen[key] == 1 else f"{key}_{seen[key]}"] = value
    return out


def _records(text: str, entity: str) -> list[str]:
    """The objects of a JSON text, a line each; numbers as text, since all primitives are read as text."""
    try:
        made = json.loads(text.removeprefix("\ufeff"), object_pairs_hook=lambda pairs: renamed_keys(pairs, entity), parse_int=str, parse_float=str)
    except ValueError:
        return []
    return [json.dumps(r, ensure_ascii=False) for r in (made if isinstance(made, list) else [made]) if isinstance(r, dict)]


def _odd_keys(text: Column) -> Column:
    """Whether a key may be blank or have white space around it; a string that looks like one counts too."""
    return text.rlike(r'[{,]\s*"(\s*|\s[^"]*|[^"]*\s)"\s*:')


def _renamed_records(texts: DataFrame, entity: str) -> DataFrame:
    """``(value)``: the records of texts whose keys repeat or are blank, with keys renamed by :func:`renamed_keys`."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r for t in batch.column(0).to_pylist() for r in _records(t, entity)], pa.string())], names=["value"])

    return texts.mapInArrow(run, "value string")


def _quoted_numbers(text: Column) -> Column:
    """``text`` with each number as a string, so that it keeps its digits; what is not a whole number stays, and does not parse."""
    return F.regexp_replace(text, r'\G((?:"(?:[^"\\]++|\\.)*+"|[^"\d-])*+)(-?+(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?+\d++)?+)(?![\w.+-])', '$1"$2"')


def _opened(texts: DataFrame) -> DataFrame:
    """``(rec)``: the objects of JSON texts ``(value)`` as variants; of a list its objects, of other texts nothing."""
    whole = texts.select(F.try_parse_json(_quoted_numbers(F.col("value"))).alias("v")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    listed = whole.select(F.explode(F.when(kind.startswith("ARRAY"), F.col("v").cast("array<variant>")).otherwise(F.array("v"))).alias("rec"))
    return listed.where(F.schema_of_variant("rec").startswith("OBJECT"))


def text_shape(shape: str) -> T.StructType:
    """The type of records of a variant shape: records and lists as they are, all else, mixtures included, as text."""
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], shape)

    def as_text(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(as_text(kind.elementType))
        return T.StringType()

    return as_text(T.DataType.fromDDL(ddl))


def _apart(kind: T.DataType) -> T.DataType:
    """The same type with fields whose names differ in case only numbered from 2, since Spark does not tell such names apart."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_apart(kind.elementType))
    if not isinstance(kind, T.StructType):
        return kind
    taken, out = {f.name.lower() for f in kind.fields}, []
    seen: set[str] = set()
    for field in kind.fields:
        name, at = field.name, 1
        while name.lower() in seen or (at > 1 and name.lower() in taken):
            at += 1
            name = f"{field.name}_{at}"
        seen.add(name.lower())
        out.append(T.StructField(name, _apart(field.dataType)))
    return T.StructType(out)


def read_json(spark: SparkSession, path: str, sample: int | None = None, entity: str = "column") -> DataFrame:
    """Records of JSON lines, of one object or of an array; lines that do not parse are left out.

    Each text is parsed to a variant. Shapes come together by an associative aggregate, in the pass that checks the texts: what is a record
    (or a list of records) everywhere is one, and anything mixed is text, in which numbers inside records are quoted. NaN and Infinity make a file invalid. Numbers keep the
    text they have in the file. A key that an object repeats is numbered from 2, as is one that differs from another in case only; a
    blank one gets the entity's name and its place; only texts with repeated or blank keys go through Python.
    """
    lines = spark.read.text(path)
    first = lines.where(F.trim("value") != "").first()
    if first is None:
        raise ValueError(f"{path} has no records")
    start = first.value.strip().removeprefix("\ufeff")
    is_lines = start.startswith("{") and bool(_records(start, entity))
    texts = (lines if is_lines else spark.read.text(path, wholetext=True)).select("value")
    bare = _without_strings(F.col("value"))
    refused = F.try_parse_json(_quoted_numbers(F.col("value"))).isNull()
    if is_lines:
        refused &= bare.rlike(r"^\s*\{.*\}\s*$")
    odd = refused | _odd_keys(F.col("value"))
    checks = texts.agg(F.bool_or(bare.rlike(r"[:\[,]\s*-?(NaN|Infinity)\s*([,}\]]|$)")).alias("no_number"), F.bool_or(odd).alias("odd"))
    shaped = lambda records: records.agg(F.schema_of_variant_agg("rec").alias("shape"))
    records = _opened(texts)
    said = checks.crossJoin(shaped(records)).first()  # one row each
    if said.no_number:
        raise ValueError(f"{path} holds NaN or Infinity")
    if said.odd:
        records = _opened(texts.where(~odd).union(_renamed_records(texts.where(odd), entity)))
        shape = shaped(records).first().shape
    else:
        shape = said.shape
    kind = text_shape(shape) if shape.startswith("OBJECT") else T.StructType()
    if not kind.fields:
        raise ValueError(f"{path} has no fields")
    df = records.select(F.col("rec").cast(kind).cast(_apart(kind)).alias("rec")).select("rec.*")
    return df.limit(sample) if sample else df


def leaf_cells(df: DataFrame) -> DataFrame:
    """``(ord, name, v)``: the text of every leaf; name is its path and ord its place among all fields, list items count each."""
    parts: list[Column] = []
    count = 0

    def cell_of(at: int, name: str):
        return lambda v: F.struct(F.lit(at).alias("ord"), F.lit(name).alias("name"), v.cast("string").alias("v"))

    def walk(struct: T.StructType, above: Column | None, prefix: str, inside: bool) -> None:
        nonlocal count
        for field in struct.fields:
            at, kind, listed = count, field.dataType, inside
            count += 1
            value = F.col("`" + field.name.replace("`", "``") + "`") if above is None else above.getField(field.name)
            while isinstance(kind, T.ArrayType):
                value = F.flatten(F.filter(value, lambda v: v.isNotNull())) if listed else value
                kind, listed = kind.elementType, True
            if isinstance(kind, T.StructType):
                walk(kind, value, f"{prefix}{field.name}.", listed)
                continue
            cell = cell_of(at, prefix + field.name)
            parts.append(F.coalesce(F.transform(value, cell), F.array().cast("array<struct<ord:int,name:string,v:string>>")) if listed else F.array(cell(value)))

    walk(df.schema, None, "", False)
    return df.select(F.inline(F.concat(*parts)))


def json_fields(entity: str, df: DataFrame) -> DataFrame:
    """Fields with RECORD and list shapes from the schema, and leaf types from the values."""
    shape = df.sparkSession.createDataFrame(declared_rows(entity, df.schema), FIELD_SCHEMA).drop("precision", "scale", "nullable").withColumnRenamed("data_type", "shape")
    found = with_precision(profile_cells(leaf_cells(df), ("ord", "name"))).select(
        "ord", "data_type", "nullable", "precision", "scale", F.col("n").alias("cells"), "distinct_ratio", "null_ratio", "ambiguous_boolean"
    )
    rows = df.count()
    out = shape.join(found, "ord", "left").withColumn("data_type", F.when(F.col("shape").isin("RECORD", "JSON"), F.col("shape")).otherwise(F.coalesce("data_type", F.lit("STRING"))))
    return out.drop("shape").withColumn("nullable", F.coalesce("nullable", F.lit(True))).withColumn("row_count", F.lit(rows).cast("long"))
