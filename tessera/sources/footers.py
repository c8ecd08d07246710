"""Declared fields of many Parquet or Avro files, from their footers and headers alone.

Files are listed by Spark and read in tasks, each where its schema lies: a Parquet footer, an Avro header. Row counts come from
the footer, or from the heads of Avro's blocks, whose bodies are skipped. The fields of all files are then merged by path, by a rule
whose outcome does not depend on their order. File systems that Python cannot seek in are read whole, by Spark, in the same tasks.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.fields import FIELD_SCHEMA, declared_rows

SEEKABLE = ("file", "hdfs", "s3", "gs")
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
# The order in which numbers of different types widen.
NUMBERS = ("INTEGER", "FLOAT", "DECIMAL")
SHAPE = "file string, rows long, said string, ord int, path string, depth int, name string, data_type string, is_array boolean, nullable boolean, description string, precision int, scale int"

# The types of Avro primitives and logical types, and the numeric widening of unions.
WIDENING = ("int", "long", "float", "double", "decimal")
PRIMITIVES = {"int": "INTEGER", "long": "INTEGER", "float": "FLOAT", "double": "FLOAT", "boolean": "BOOLEAN", "string": "STRING", "bytes": "STRING"}
LOGICAL = {"timestamp-millis": "TIMESTAMP", "timestamp-micros": "TIMESTAMP", "date": "DATE", "decimal": "DECIMAL"}


def arrow_type(kind: pa.DataType) -> str:
    """The canonical type of an Arrow type; what has none, times of day among them, is STRING."""
    t = pa.types
    tests = (("DECIMAL", t.is_decimal), ("INTEGER", t.is_integer), ("FLOAT", lambda k: t.is_float32(k) or t.is_float64(k)), ("BOOLEAN", t.is_boolean), ("TIMESTAMP", t.is_timestamp), ("DATE", t.is_date), ("JSON", t.is_map), ("RECORD", t.is_struct))
    return next((name for name, test in tests if test(kind)), "STRING")


def arrow_rows(schema: pa.Schema) -> list[tuple]:
    """Fields of an Arrow schema, parents before children, with its descriptions; nested lists count as one."""
    out: list[tuple] = []

    def walk(fields, prefix: str, depth: int) -> None:
        for f in fields:
            kind, repeated = f.type, False
            while True:
                if pa.types.is_dictionary(kind):
                    kind = kind.value_type
                elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
                    kind, repeated = kind.value_type, True
                else:
                    break
            if pa.types.is_union(kind):
                raise ValueError(f"{prefix}{f.name}: a union has no one type")
            decimal = pa.types.is_decimal(kind) and not repeated
            said = (f.metadata or {}).get(b"description")
            out.append((len(out), prefix + f.name, depth, f.name, arrow_type(kind), repeated, f.nullable, said.decode() if said else None, kind.precision if decimal else None, kind.scale if decimal else None))
            if pa.types.is_struct(kind):
                walk([kind.field(i) for i in range(kind.num_fields)], f"{prefix}{f.name}.", depth + 1)

    walk(schema, "", 1)
    return out


def parquet_footer(source) -> tuple[int, str | None, list[tuple]]:
    """(rows, description, fields) of a Parquet file. What Spark wrote declares Spark's own types."""
    found = pq.ParquetFile(source)
    own = (found.metadata.metadata or {}).get(SPARK_SCHEMA)
    rows = [(r[1], r[2], r[3], r[4], *r[6:]) for r in declared_rows("", T.StructType.fromJson(json.loads(own)))] if own else arrow_rows(found.schema_arrow)
    return found.metadata.num_rows, None, rows


def _plain(kind, where: str):
    """(type, repeated, nullable) of an Avro type, with unions and lists resolved."""
    if isinstance(kind, list):
        options = [k for k in kind if k != "null"]
        if not options:
            raise ValueError(f"{where}: a union of null alone")
        if len(options) > 1:
            names = ["decimal" if isinstance(o, dict) and o.get("logicalType") == "decimal" else o for o in options]
            if not all(isinstance(n, str) and n in WIDENING for n in names):
                raise ValueError(f"{where}: a union of {names} has no one type")
            return max(names, key=WIDENING.index), False, "null" in kind
        found, repeated, _ = _plain(options[0], where)
        return found, repeated, "null" in kind
    if isinstance(kind, dict) and kind.get("type") == "array":
        return _plain(kind["items"], where)[0], True, False
    return kind, False, False


def avro_rows(schema: dict) -> list[tuple]:
    """Fields of a record's Avro schema, parents before children."""
    if schema.get("type") != "record":
        raise ValueError(f"the file holds {schema.get('type')}, not records")
    out: list[tuple] = []

    def walk(fields, prefix, depth, parents):
        for f in fields:
            name, where = f["name"], prefix + f["name"]
            kind, repeated, nullable = _plain(f["type"], where)
            precision = scale = children = None
            if isinstance(kind, dict):
                logical, base = kind.get("logicalType"), kind.get("type")
                if base == "record":
                    if kind["name"] in parents:
                        raise ValueError(f"{where}: {kind['name']} holds itself")
                    data_type, children = "RECORD", kind
                elif base == "map":
                    data_type = "JSON"
                elif logical in LOGICAL:
                    data_type = LOGICAL[logical]
                    precision, scale = (kind.get("precision"), kind.get("scale", 0)) if logical == "decimal" else (None, None)
                else:
                    data_type = PRIMITIVES.get(base, "STRING")
            else:
                data_type = "DECIMAL" if kind == "decimal" else PRIMITIVES.get(kind, "STRING")
            out.append((len(out), where, depth, name, data_type, repeated, nullable, f.get("doc"), precision, scale))
            if children:
                walk(children["fields"], where + ".", depth + 1, {*parents, children["name"]})

    walk(schema["fields"], "", 1, {schema["name"]})
    return out


def avro_header(source) -> tuple[int, str | None, list[tuple]]:
    """(rows, description, fields) of an Avro file; of its blocks only the heads are read."""
    def number() -> int:
        value = shift = 0
        while True:
            byte = source.read(1)
            if not byte:
                raise ValueError("an Avro file ends too early")
            value, shift = value | (byte[0] & 127) << shift, shift + 7
            if byte[0] < 128:
                return (value >> 1) ^ -(value & 1)

    if source.read(4) != b"Obj\x01":
        raise ValueError("not an Avro object container file")
    meta: dict[bytes, bytes] = {}
    while n := number():
        if n < 0:
            number()
        for _ in range(abs(n)):
            key = source.read(number())
            meta[key] = source.read(number())
    source.read(16)
    schema, rows, size = json.loads(meta[b"avro.schema"]), 0, source.size()
    while source.tell() < size:
        rows += number()
        body = number()
        source.seek(source.tell() + body + 16)
    if source.tell() != size:
        raise ValueError("an Avro file ends too early")
    return rows, (schema.get("doc") or "").strip() or None, avro_rows(schema)


READERS = {"parquet": parquet_footer, "avro": avro_header}


def _opened(path: str, content: bytes | None):
    if content is not None:
        return pa.BufferReader(content)
    if path.startswith("file:"):
        return pa.OSFile("/" + path[5:].lstrip("/"))
    files, place = pa.fs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the files under a path; without its content, where Python can seek, a file is listed and not read."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    listed = listed.where((F.col("length") > 0) & ~name.startswith("_") & ~name.startswith("."))
    return listed.select("path", (F.lit(None).cast("binary") if scheme in SEEKABLE else F.col("content")).alias("content"))


def file_fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of SHAPE: the fields that each file under a path declares, and how many rows it has."""
    def run(batches):
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(file, content) as source:
                    rows, said, fields = READERS[kind](source)
                made = [(file, rows, said, *f) for f in fields] or [(file, rows, said, *[None] * 10)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SHAPE.split(", ")])

    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in SHAPE.split(", ")]
    return _files(spark, path).mapInArrow(run, SHAPE)


def column_ranges(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(file, rows, least, most)`` of a top-level column, in its own type, from the statistics in Parquet footers."""
    kind = spark.read.parquet(path).schema[column].dataType

    def run(batches):
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(file, content) as source:
                    meta = pq.ParquetFile(source).metadata
                    own = [meta.row_group(g).column(c).statistics for g in range(meta.num_row_groups) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == column]
                    held = [s for s in own if s is not None and s.has_min_max]
                    least, most = (min(s.min for s in held), max(s.max for s in held)) if held else (None, None)
                    said = lambda v: None if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([meta.num_rows], pa.int64()), pa.array([said(least)], pa.string()), pa.array([said(most)], pa.string())], names=["file", "rows", "least", "most"])

    found = _files(spark, path).mapInArrow(run, "file string, rows long, least string, most string")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("least", "most")})


def merged_fields(found: DataFrame, entity: str) -> DataFrame:
    """Rows of FIELD_SCHEMA and ``row_count``: one field a path out of those of all files.

    Numbers of different types take the widest, other types that differ become STRING; a record on one side alone is an error. A field
    is a list, or may be null, where it is so in any file; one that a file lacks may be null. Decimals get digits for all.
    Descriptions and order are those of the first file by name that has them.
    """
    total = found.groupBy("file").agg(F.max("rows").alias("rows")).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("row_count"))  # one row
    kinds, whole = F.col("kinds"), F.max(F.col("precision") - F.col("scale"))
    rows = found.where("path is not null").groupBy("path", "depth").agg(
        F.min(F.struct("file", "ord")).alias("first"), F.min("name").alias("name"), F.array_sort(F.collect_set("data_type")).alias("kinds"), F.bool_or("is_array").alias("is_array"), F.bool_or("nullable").alias("nullable"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("file"))).alias("description"), whole.alias("whole"), F.max("scale").alias("scale"), F.count(F.lit(1)).alias("seen"),
    ).join(F.broadcast(total))
    numbers = F.size(F.array_except(kinds, F.array(*map(F.lit, NUMBERS)))) == 0
    widest = F.when(F.array_contains(kinds, "DECIMAL"), "DECIMAL").when(F.array_contains(kinds, "FLOAT"), "FLOAT").otherwise("INTEGER")
    one = F.when(F.size(kinds) == 1, kinds[0]).when(numbers, widest).when(F.array_contains(kinds, "RECORD"), F.raise_error(F.concat("path", F.lit(" is a record in some files only")))).otherwise("STRING")
    decimal = one == "DECIMAL"
    return rows.select(
        F.lit(entity).alias("entity"), F.col("first.ord").alias("ord"), "path", "depth", "name", F.col("name").alias("raw_name"), one.alias("data_type"), "is_array",
        (F.col("nullable") | (F.col("seen") < F.col("files"))).alias("nullable"), "description", F.when(decimal, F.col("whole") + F.col("scale")).alias("precision"), F.when(decimal, F.col("scale")).alias("scale"), "row_count",
    )


def fields_of(spark: SparkSession, path: str, entity: str, kind: str) -> tuple[DataFrame, str | None]:
    """Merged fields of the files under a path, and the first description that a file has of its records."""
    rows = spark.createDataFrame(merged_fields(file_fields(spark, path, kind), entity).collect(), FIELD_SCHEMA + ", row_count long")  # one row a column
    said = file_fields(spark, path, kind).where("said is not null").agg(F.min_by("said", "file")).first()[0] if kind == "avro" else None
    return rows, said
