"""Registered queries that write given tables as CSV and JSON to the shared folder, and read them through the sources.

So each line takes the whole way: writing, cleaning, delimiter and header, cells, and types of what is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import advice, fields, layout, profile
from tessera.plans.process import Request, process, renamed
from tessera.plans.queries import infer_sql, table
from tessera.sources import csv_source, declared, json_source
from tessera.sources.detect import detect_format
from tessera.sources.shared import shared_path
from tessera.standards import METADATA_COLUMNS


def written(lines: DataFrame, header: str) -> str:
    """The path of ``(line)`` as CSV files, each with the header line; lines are written as they are."""
    path = shared_path(lines.sparkSession, "csv") + ".csv"
    raw = lines.select(F.col("line").alias(header)).write.option("header", True).option("quote", "\x00").option("sep", "\x01").option("comment", "\x02")
    raw.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _joined(sep: str, *columns) :
    return F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).alias("line")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select(_joined(",", c("o_orderkey"), c("o_custkey"), c("o_totalprice").cast("decimal(18,2)"), F.date_format("o_orderdate", "yyyy-MM-dd"), c("o_orderpriority"), c("o_orderstatus")))


ORDER_HEADER = "o_orderkey,o_custkey,o_totalprice,o_orderdate,o_orderpriority,o_orderstatus"


def csv_scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV, with delimiter and header found by looking."""
    path = written(_order_lines(spark, sf_dir), ORDER_HEADER)
    assert detect_format(spark, path) == "csv"
    return csv_source.read_csv(spark, path, "orders").rows


CSV_SCAN_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, o_orderstatus FROM orders"""


def csv_fields_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of that CSV, with the types its values support, and one overridden."""
    read = csv_source.read_csv(spark, written(_order_lines(spark, sf_dir), ORDER_HEADER), "orders")
    found = csv_source.csv_fields(read, "orders", overrides={"oCustkey": "STRING"})
    return found.select("name", "data_type", "precision", "scale", "nullable", "row_count", "distinct_ratio", "null_ratio", "max_length")


_COUNTED = """CAST(count(*) AS BIGINT) AS row_count, round_even(count(DISTINCT {0}) / CAST(count(*) AS DOUBLE), 4) AS distinct_ratio, CAST(0 AS DOUBLE) AS null_ratio, CAST(max(length({0})) AS INTEGER) AS max_length"""
CSV_FIELDS_SQL = f"WITH t AS ({CSV_SCAN_SQL}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, '{k}' AS data_type, {"CAST(max(length(replace(o_totalprice, '.', ''))) AS INTEGER)" if k == "DECIMAL" else "CAST(NULL AS INTEGER)"} AS precision,
  {"2" if k == "DECIMAL" else "CAST(NULL AS INTEGER)"} AS scale, false AS nullable, {_COUNTED.format(c)} FROM t"""
    for c, k in (("o_orderkey", "INTEGER"), ("o_custkey", "STRING"), ("o_totalprice", "DECIMAL"), ("o_orderdate", "DATE"), ("o_orderpriority", "STRING"), ("o_orderstatus", "STRING"))
)


def csv_scan_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers cut at a given delimiter, among comments and blank lines; a quoted name holds the delimiter."""
    rows = table(spark, sf_dir, "customer")
    line = _joined(";", F.col("c_custkey"), F.concat(F.lit('"'), "c_name", F.lit(';""'), "c_mktsegment", F.lit('"""')), F.col("c_nationkey"))
    key = F.col("c_custkey")
    more = F.when(key % 3 == 0, F.array(F.lit("# a note; not a row"), line)).when(key % 3 == 1, F.array(F.lit("  -- nor this"), line, F.lit(" "))).otherwise(F.array(line))
    path = written(rows.select(F.explode(more).alias("line")), "key;name;nation")
    return csv_source.read_csv(spark, path, "customer", mode="SPLIT", delimiter=";", header_mode="PRESENT").rows


CSV_SEMICOLON_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ';"' || c_mktsegment || '"' AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer"""


def csv_single_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as a table of one column whose header looks malformed; names like the header are data."""
    lines = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 50 == 0, "part name").otherwise(F.col("p_name")).alias("line"))
    read = csv_source.read_csv(spark, written(lines, "part name"), "part", mode="SINGLE", header_mode="PRESENT")
    return read.rows.groupBy("part name").agg(F.count(F.lit(1)).alias("n")).select(F.col("part name").alias("part_name"), "n", F.lit(read.warning).alias("warning"))


CSV_SINGLE_SQL = """SELECT part_name, CAST(count(*) AS BIGINT) AS n, 'POTENTIAL_MALFORMED_HEADER' AS warning
FROM (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'part name' ELSE p_name END AS part_name FROM part) GROUP BY part_name"""


def csv_wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are quoted as a whole, with a blank name in the header."""
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit('"'), _joined(",", F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")), F.lit('"')).alias("line"))
    return csv_source.read_csv(spark, written(lines, '"s_suppkey,,s_nationkey"'), "supplier", header_mode="PRESENT", remove_quotes=True).rows


CSV_WRAPPED_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name AS supplier_2, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier"


def _uneven(spark: SparkSession, sf_dir: str) -> str:
    """Customers of three columns, some lines without the last, some with one or two more."""
    key = F.col("c_custkey")
    base = F.concat_ws(",", key.cast("string"), "c_mktsegment")
    line = F.when(key % 11 == 0, base).when(key % 13 == 0, F.concat(base, F.lit(",7,x,y"))).when(key % 17 == 0, F.concat(base, F.lit(",7,x"))).otherwise(F.concat(base, F.lit(",7")))
    return written(table(spark, sf_dir, "customer").select(line.alias("line")), "id,segment,seven")


def csv_width_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not fit the header, as read: what they lack, what they have over, and how they map."""
    wrong = csv_source.read_csv(spark, _uneven(spark, sf_dir), "customer", header_mode="PRESENT").mismatches
    return wrong.select("line", "expected", "actual", F.array_join("missing_columns", ",").alias("missing"), F.array_join("extra_values", ",").alias("extra"), F.col("mapped_preview")["seven"].alias("seven"))


CSV_REPORT_SQL = """WITH t AS (SELECT c_custkey AS k, c_custkey || ',' || c_mktsegment AS base FROM customer)
SELECT base || CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN ',7,x,y' ELSE ',7,x' END AS line, 3 AS expected, CASE WHEN k % 11 = 0 THEN 2 WHEN k % 13 = 0 THEN 5 ELSE 4 END AS actual,
  CASE WHEN k % 11 = 0 THEN 'seven' ELSE '' END AS missing, CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'x,y' ELSE 'x' END AS extra, CASE WHEN k % 11 = 0 THEN '<MISSING>' ELSE '7' END AS seven
FROM t WHERE k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0"""


def csv_confirmed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a confirmed malformed table: the column that short lines lack is text, and not nullable."""
    key = F.col("c_custkey")
    lines = table(spark, sf_dir, "customer").select(F.concat_ws(",", key.cast("string"), "c_mktsegment", F.when(key % 5 != 0, key.cast("string"))).alias("line"))
    read = csv_source.read_csv(spark, written(lines, "id,segment,again"), "customer", header_mode="PRESENT")
    return csv_source.csv_fields(read, "customer", confirmed=True).select("name", "data_type", "nullable", "row_count", "null_ratio")


CSV_CONFIRMED_SQL = """SELECT 'id' AS name, 'INTEGER' AS data_type, false AS nullable, CAST(count(*) AS BIGINT) AS row_count, CAST(0 AS DOUBLE) AS null_ratio FROM customer
UNION ALL SELECT 'segment', 'STRING', false, count(*), 0 FROM customer
UNION ALL SELECT 'again', 'STRING', false, count(*), round_even(count(*) FILTER (c_custkey % 5 = 0) / CAST(count(*) AS DOUBLE), 4) FROM customer"""

# --- JSON ------------------------------------------------------------------------------------------


def _json(spark: SparkSession, lines: DataFrame) -> DataFrame:
    path = shared_path(spark, "json") + ".jsonl"
    lines.write.text(path)
    assert detect_format(spark, path) == "json"
    return json_source.read_json(spark, path)


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    record = F.struct(
        c("event_id").alias("id"), F.struct(c("user_id").alias("key"), c("event_type").alias("kind")).alias("user"), F.array(F.year("ts"), F.month("ts")).alias("parts"),
        F.array(F.struct(c("event_type").alias("name"), c("value").cast("decimal(18,3)").alias("worth")), F.struct(F.lit("NaN, {not} a \"constant\"").alias("name"), F.lit(None).cast("decimal(18,3)").alias("worth"))).alias("items"),
        F.when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"),
    )
    bad = F.when(c("event_id") % 7 == 0, F.array(F.to_json(record), F.lit('{"id": broken'))).otherwise(F.array(F.to_json(record)))
    return table(spark, sf_dir, "events").select(F.explode(bad).alias("value"))


def json_leaf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of nested records, counted by path and text; lines that do not parse are left out."""
    return json_source.leaf_cells(_json(spark, _event_lines(spark, sf_dir))).groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))


_LEAVES = """leaves AS (SELECT 'id' AS name, CAST(event_id AS VARCHAR) AS v FROM events UNION ALL SELECT 'user.key', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'user.kind', event_type FROM events
  UNION ALL SELECT 'parts', CAST(year(ts) AS VARCHAR) FROM events UNION ALL SELECT 'parts', CAST(month(ts) AS VARCHAR) FROM events
  UNION ALL SELECT 'items.name', event_type FROM events UNION ALL SELECT 'items.name', 'NaN, {not} a "constant"' FROM events
  UNION ALL SELECT 'items.worth', CAST(CAST(value AS DECIMAL(18,3)) AS VARCHAR) FROM events UNION ALL SELECT 'items.worth', NULL FROM events
  UNION ALL SELECT 'at', CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END FROM events)"""
JSON_LEAF_SQL = f"WITH {_LEAVES} SELECT name, v, CAST(count(*) AS BIGINT) AS n FROM leaves GROUP BY name, v"


def json_record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested records: shapes from the records, types from the leaves."""
    found = json_source.json_fields("events", _json(spark, _event_lines(spark, sf_dir)))
    return found.select("path", "depth", "data_type", "is_array", "nullable", "row_count", "cells", "distinct_ratio")


JSON_FIELDS_SQL = f"""WITH {_LEAVES}, kinds(path, depth, data_type, is_array) AS (VALUES ('id', 1, 'INTEGER', false), ('user', 1, 'RECORD', false), ('user.key', 2, 'INTEGER', false), ('user.kind', 2, 'STRING', false),
  ('parts', 1, 'INTEGER', true), ('items', 1, 'RECORD', true), ('items.name', 2, 'STRING', false), ('items.worth', 2, 'DECIMAL', false), ('at', 1, 'TIMESTAMP', false)),
c AS (SELECT name, count(*) AS cells, count(DISTINCT v) AS d, bool_or(v IS NULL) AS nullable FROM leaves GROUP BY name)
SELECT path, CAST(depth AS INTEGER) AS depth, data_type, is_array, coalesce(nullable, true) AS nullable, (SELECT count(*) FROM events) AS row_count, CAST(cells AS BIGINT) AS cells, round_even(d / CAST(cells AS DOUBLE), 4) AS distinct_ratio
FROM kinds LEFT JOIN c ON c.name = path"""


def json_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that repeat a key, which is numbered from 2, inside lists as well."""
    c = F.col
    line = F.concat(F.lit('{"k": '), c("event_id").cast("string"), F.lit(', "k": 1.50, "in": [{"x": "'), c("event_type"), F.lit('", "x": 2}], "k": null}'))
    plain = F.concat(F.lit('{"k": '), c("event_id").cast("string"), F.lit("}"))
    df = _json(spark, table(spark, sf_dir, "events").select(F.when(c("event_id") % 3 == 0, line).otherwise(plain).alias("value")))
    return df.select("k", "k_2", F.col("k_3").isNull().alias("third_empty"), F.col("in")[0]["x"].alias("x"), F.col("in")[0]["x_2"].alias("x_2"))


JSON_REPEATED_SQL = """SELECT CAST(event_id AS VARCHAR) AS k, CASE WHEN event_id % 3 = 0 THEN '1.50' END AS k_2, true AS third_empty,
  CASE WHEN event_id % 3 = 0 THEN event_type END AS x, CASE WHEN event_id % 3 = 0 THEN '2' END AS x_2 FROM events"""


def json_blank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a blank key, which is named after the entity and its place, and keys with spaces or points."""
    c = F.col
    line = F.concat(F.lit('{"id": '), c("event_id").cast("string"), F.lit(', "": "'), c("event_type"), F.lit('", " kind ": 7, "a.b": {"": '), c("user_id").cast("string"), F.lit(', "c": [1, 2]}}'))
    path = shared_path(spark, "json") + ".jsonl"
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    cells = json_source.leaf_cells(json_source.read_json(spark, path, entity="event"))
    return cells.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"), F.min("v").alias("least"))


JSON_BLANK_SQL = """WITH c AS (SELECT 'id' AS name, CAST(event_id AS VARCHAR) AS v FROM events UNION ALL SELECT 'event_2', event_type FROM events UNION ALL SELECT 'kind', '7' FROM events
  UNION ALL SELECT 'a.b.event_1', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'a.b.c', unnest(['1', '2']) FROM events)
SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT v) AS BIGINT) AS d, min(v) AS least FROM c GROUP BY name"""


def json_mixed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and leaves of keys that hold records, lists and scalars by turns, of keys with points, and of keys that differ in case only."""
    kind = F.col("o_orderstatus")
    number = F.col("o_orderkey").cast("string")
    mixed = F.when(kind == "F", F.concat(F.lit('{"k": "'), number, F.lit('"}'))).when(kind == "O", F.lit('["x"]')).otherwise(number)
    maybe = F.when(kind == "F", F.concat(F.lit('{"in": ['), number, F.lit('.50]}'))).otherwise("null")
    parts = (F.lit('{"Id": '), number, F.lit(', "id": "b", "mixed": '), mixed, F.lit(', "maybe": '), maybe, F.lit(', "each": [{"k": 1}, "y"], "a.b": {"c.d": true}, "none": [], "sub": {"x": [[{"y": '), number, F.lit("}], []]}}"))
    df = _json(spark, table(spark, sf_dir, "orders").select(F.concat(*parts).alias("value")))
    leaves = json_source.leaf_cells(df).groupBy(F.col("name").alias("path")).agg(F.count(F.lit(1)).alias("leaves"), F.count_distinct("v").alias("texts"), F.min("v").alias("least"))
    return json_source.json_fields("orders", df).select("path", "depth", "data_type", "is_array").join(leaves, "path", "left")


JSON_MIXED_SQL = """WITH o AS (SELECT o_orderstatus AS s, CAST(o_orderkey AS VARCHAR) AS k FROM orders), leaf AS (SELECT 'Id' AS path, k AS v FROM o UNION ALL SELECT 'id_2', 'b' FROM o
  UNION ALL SELECT 'mixed', CASE s WHEN 'F' THEN '{"k":"' || k || '"}' WHEN 'O' THEN '["x"]' ELSE k END FROM o UNION ALL SELECT 'maybe.in', k || '.50' FROM o WHERE s = 'F'
  UNION ALL SELECT 'each', unnest(['{"k":"1"}', 'y']) FROM o UNION ALL SELECT 'a.b.c.d', 'true' FROM o UNION ALL SELECT 'sub.x.y', k FROM o),
kinds(path, depth, data_type, is_array) AS (VALUES ('Id', 1, 'INTEGER', false), ('id_2', 1, 'STRING', false), ('mixed', 1, 'STRING', false), ('maybe', 1, 'RECORD', false), ('maybe.in', 2, 'DECIMAL', true),
  ('each', 1, 'STRING', true), ('a.b', 1, 'RECORD', false), ('a.b.c.d', 2, 'BOOLEAN', false), ('none', 1, 'STRING', true), ('sub', 1, 'RECORD', false), ('sub.x', 2, 'RECORD', true), ('sub.x.y', 3, 'INTEGER', false))
SELECT kinds.path, CAST(depth AS INTEGER) AS depth, data_type, is_array, leaves, texts, least FROM kinds
LEFT JOIN (SELECT path, CAST(count(*) AS BIGINT) AS leaves, CAST(count(DISTINCT v) AS BIGINT) AS texts, min(v) AS least FROM leaf GROUP BY path) l ON l.path = kinds.path"""


def parquet_footers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of files whose writers declare different types, from their footers: numbers widen, others become text, what some lack may be null."""
    rows, path = table(spark, sf_dir, "orders"), shared_path(spark, "footers") + ".parquet"
    early = rows.select(F.col("o_orderkey").cast("int").alias("key"), F.col("o_totalprice").cast("decimal(12,2)").alias("total"), F.col("o_orderdate").cast("date").alias("day"), F.struct(F.col("o_custkey").alias("id")).alias("customer"))
    late = rows.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("decimal(14,4)").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.struct(F.col("o_custkey").cast("double").alias("id"), F.array("o_orderstatus").alias("states")).alias("customer"))
    early.where("o_orderstatus != 'F'").withMetadata("key", {"comment": "the order"}).write.parquet(f"{path}/early")
    late.where("o_orderstatus = 'F'").write.parquet(f"{path}/late")
    found = declared.parquet_fields(spark, path, "orders")
    return found.select("path", "depth", "data_type", "is_array", "nullable", "description", "precision", "scale", "row_count")


FOOTER_SQL = """SELECT path, CAST(depth AS INTEGER) AS depth, data_type, is_array, path != 'customer' AS nullable, CASE path WHEN 'key' THEN 'the order' END AS description, CAST(precision AS INTEGER) AS precision, CAST(scale AS INTEGER) AS scale, (SELECT count(*) FROM orders) AS row_count
FROM (VALUES ('key', 1, 'INTEGER', false, NULL, NULL), ('total', 1, 'DECIMAL', false, 14, 4), ('day', 1, 'STRING', false, NULL, NULL), ('customer', 1, 'RECORD', false, NULL, NULL), ('customer.id', 2, 'FLOAT', false, NULL, NULL), ('customer.states', 2, 'STRING', true, NULL, NULL)) AS v(path, depth, data_type, is_array, precision, scale)"""


def layout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as advised, a folder a day and sorted ranges of users, and read back; do a day's files hold ranges apart, and are few opened for a user?"""
    rows, path = table(spark, sf_dir, "events"), shared_path(spark, "layout") + ".parquet"
    counted = fields.declared_fields(spark, {"events": rows}).withColumn("row_count", F.lit(rows.count()))
    advised = advice.partition_advice(counted, "raw").first().asDict()
    layout.write_laid_out(rows, path, advised, ["user_id", "event_type"], files=48)
    back = spark.read.parquet(path).groupBy("ts_date").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("least"), F.max("user_id").alias("most"), F.count_distinct("user_id", "event_type").alias("pairs"))
    found = layout.ranges(spark, path, "user_id").withColumn("ts_date", F.regexp_extract("file", "ts_date=([^/]+)", 1).cast("date"))
    after = F.lead("least").over(Window.partitionBy("ts_date").orderBy("least", "most"))
    opened = layout.must_open(found, 40, 40).groupBy("ts_date").agg(F.count(F.lit(1)).alias("opened"))
    files = found.withColumn("after", after).groupBy("ts_date").agg(F.bool_and(F.coalesce(F.col("most") <= F.col("after"), F.lit(True))).alias("apart"), F.count(F.lit(1)).alias("files"), F.sum("rows").alias("said"))
    few = F.coalesce("opened", F.lit(0)) <= F.greatest(F.lit(2), F.col("files") / 2)
    return back.join(files, "ts_date").join(opened, "ts_date", "left").select("ts_date", "n", "least", "most", "pairs", "said", "apart", few.alias("few"))


LAYOUT_SQL = """SELECT CAST(ts AS DATE) AS ts_date, CAST(count(*) AS BIGINT) AS n, min(user_id) AS least, max(user_id) AS most, CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS said, true AS apart, true AS few
FROM events GROUP BY CAST(ts AS DATE)"""

# --- inferred types --------------------------------------------------------------------------------

FLAGS = {
    "yes_no": "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'n' END", "zero_one": "CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END", "mixed_flag": "CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE '0' END",
    "blank": "CASE WHEN o_orderstatus = 'F' THEN '' END", "null_texts": "CASE WHEN o_orderstatus = 'F' THEN 'NULL' ELSE 'null' END",
    "signed": "concat('-', CAST(o_custkey AS VARCHAR))", "grouped": "concat('1_', CAST(o_custkey AS VARCHAR))", "points": "concat(CAST(o_custkey AS VARCHAR), '.25')", "some_points": "concat(CAST(o_custkey AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN '.5' ELSE '' END)",
    "exponents": "concat(CAST(o_custkey AS VARCHAR), 'e-3')", "not_a_number": "CASE WHEN o_orderstatus = 'F' THEN 'nan' ELSE '1.5' END", "suffixed": "concat(CAST(o_custkey AS VARCHAR), 'd')",
}
_DAY = "lpad(CAST(o_custkey % 28 + 1 AS VARCHAR), 2, '0')"
TIMES = {
    "zulu": f"concat('2024-01-', {_DAY}, 'T10:00:00Z')", "offset_time": f"concat('2024-01-', {_DAY}, CASE WHEN o_orderstatus = 'F' THEN 'T10:00:00.125+05:30' ELSE ' 10:00Z' END)", "no_zone": f"concat('2024-01-', {_DAY}, ' 10:00:00')",
    "one_without_zone": f"concat('2024-01-', {_DAY}, 'T10:00:00', CASE WHEN o_orderkey % 100 = 0 THEN '' ELSE 'Z' END)", "plain_date": f"concat('2024-02-', {_DAY})",
    "mixed_dates": f"CASE WHEN o_orderstatus = 'F' THEN concat({_DAY}, '-12-2023') WHEN o_orderstatus = 'O' THEN concat('12/', {_DAY}, '/2023') ELSE concat({_DAY}, '/1/2023') END", "impossible_date": "concat('2023-02-', CAST(29 + o_custkey % 3 AS VARCHAR))",
}
SHAPES = {
    "point": "concat('Point(', CAST(o_custkey AS VARCHAR), ' 4)')", "shapes": "concat(CASE WHEN o_orderstatus = 'F' THEN 'LINESTRING(' ELSE 'multipolygon(' END, CAST(o_custkey AS VARCHAR), ')')", "spaced_shape": "concat('POINT (', CAST(o_custkey AS VARCHAR), ')')",
    "period": f"concat('[2024-01-', {_DAY}, ', 2024-02-01)')", "open_period": f"concat('(2024-01-', {_DAY}, ',2024-02-01', CASE WHEN o_orderstatus = 'F' THEN ']' ELSE ')' END)", "half_period": f"concat('[2024-01-', {_DAY}, ',)')",
}
STATED = ("name", "n_kept", "data_type", "ambiguous_boolean", "any_naive")


def inferred(columns: dict[str, str]):
    """The types of texts made from orders."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = table(spark, sf_dir, "orders").selectExpr(*(f"{e.replace('VARCHAR', 'STRING')} AS {n}" for n, e in columns.items()))
        return profile.with_precision(profile.profile(made)).select(*STATED)

    return run


def inferred_sql(columns: dict[str, str]) -> str:
    made = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return infer_sql("made", tuple(columns)).replace("WITH ", f"WITH made AS (SELECT {made} FROM orders), ", 1)


# --- a whole run -------------------------------------------------------------------------------------


def process_customer_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a run makes of a CSV file: named, typed, with metadata columns and descriptions."""
    lines = table(spark, sf_dir, "customer").select(_joined(",", F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal").cast("decimal(18,2)"), F.col("c_mktsegment")))
    request = Request(written(lines, "customerID,Full Name,order,fullName"), "customer", "sales", "dev", "raw", "gold", "Customers of the shop, one row each", csv={"header_mode": "PRESENT"})
    out = process(spark, request)
    columns = [(out["dataset"], out["table"], out["decision"], i, c["name"], c["type"], c["mode"]) for i, c in enumerate(out["columns"])]
    rows = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("read"))
    return spark.createDataFrame(columns, "dataset string, table string, decision string, ord int, name string, type string, mode string").crossJoin(F.broadcast(rows))  # one row


PROCESS_SQL = """SELECT 'sales_dev_raw' AS dataset, 'sales_customer_gold' AS "table", 'CREATE' AS decision, CAST(ord AS INTEGER) AS ord, name, type, mode, (SELECT count(*) FROM customer) AS read
FROM (VALUES (0, 'customer_id', 'INTEGER', 'NULLABLE'), (1, 'full_name', 'STRING', 'NULLABLE'), (2, 'sales_customer_gold_order', 'NUMERIC', 'NULLABLE'), (3, 'full_name_2', 'STRING', 'NULLABLE'),
  (4, '_ingestion_timestamp', 'TIMESTAMP', 'REQUIRED'), (5, '_source_system', 'STRING', 'REQUIRED'), (6, '_batch_id', 'STRING', 'REQUIRED'), (7, '_record_hash', 'STRING', 'REQUIRED'),
  (8, '_is_deleted', 'BOOLEAN', 'REQUIRED'), (9, '_deleted_timestamp', 'TIMESTAMP', 'REQUIRED'), (10, '_op_type', 'STRING', 'REQUIRED'), (11, '_op_ts', 'TIMESTAMP', 'REQUIRED')) AS v(ord, name, type, mode)"""


def process_artifacts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files that a run makes of a CSV of orders under manual choices, and its audit row."""
    audit = shared_path(spark, "audit")
    request = Request(
        written(_order_lines(spark, sf_dir), ORDER_HEADER), "orders", "sales", "dev", "raw", "gold", "Orders of the shop, one row each", csv={"header_mode": "PRESENT"}, user_id="tester", audit=audit,
        partition_override={"column": "o_orderdate", "column_type": "DATE"}, cluster_override=["o_custkey", "o_orderstatus"], type_overrides={"o_custkey": "STRING"},
    )
    made = process(spark, request)["artifacts"]
    files = spark.createDataFrame([(name, made[name]) for name in ("create_table.sql", "create_table_spark.sql", "schema.yaml")], "artifact string, text string")
    run = spark.read.parquet(audit).select(F.lit("audit").alias("artifact"), F.concat_ws(" ", "user_id", "entity", "format", "policy", "decision", "status", F.col("version").cast("string")).alias("text"))
    rows = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("read"))
    return files.union(run).crossJoin(F.broadcast(rows))  # one row


def _artifact_sql() -> str:
    own = (("o_orderkey", "integer"), ("o_custkey", "string"), ("o_totalprice", "decimal"), ("o_orderdate", "date"), ("o_orderpriority", "string"), ("o_orderstatus", "string"))
    said = [(n, "NUMERIC" if k == "decimal" else k.upper(), "NULLABLE", f"{n.replace('_', ' ').capitalize()} stored as {k} value. Nullable field.") for n, k in own] + list(METADATA_COLUMNS)
    values = ", ".join(f"({i}, '{n}', '{k}', '{m}', '{d}')" for i, (n, k, m, d) in enumerate(said))
    spark = "CASE kind WHEN 'INTEGER' THEN 'BIGINT' WHEN 'NUMERIC' THEN 'DECIMAL(38,9)' ELSE kind END"
    required = "CASE mode WHEN 'REQUIRED' THEN ' NOT NULL' ELSE '' END"
    lines = lambda text: f"string_agg({text}, ',' || chr(10) || '  ' ORDER BY ord)"
    ddl = lines(f"'`' || name || '` ' || kind || {required} || ' OPTIONS(description=' || chr(34) || said || chr(34) || ')'")
    own_ddl = lines(f"'`' || name || '` ' || {spark} || {required} || ' COMMENT ' || chr(39) || said || chr(39)")
    return f"""WITH f(ord, name, kind, mode, said) AS (VALUES {values}), t AS (
SELECT 'create_table.sql' AS artifact, 'CREATE SCHEMA IF NOT EXISTS `sales_dev_raw`' || chr(10) || 'OPTIONS(location=''US'');' || chr(10) || chr(10) || 'CREATE TABLE IF NOT EXISTS `sales_dev_raw.sales_orders_gold` (' || chr(10) || '  '
  || {ddl} || chr(10) || ')' || chr(10) || 'PARTITION BY `o_orderdate`' || chr(10) || 'CLUSTER BY `o_custkey`, `o_orderstatus`' || chr(10)
  || 'OPTIONS(' || chr(10) || '  description="Orders of the shop, one row each"' || chr(10) || ');' || chr(10) AS text FROM f
UNION ALL SELECT 'create_table_spark.sql', 'CREATE TABLE IF NOT EXISTS `sales_dev_raw`.`sales_orders_gold` (' || chr(10) || '  ' || {own_ddl} || chr(10) || ') USING parquet' || chr(10)
  || 'PARTITIONED BY (`o_orderdate`)' || chr(10) || 'CLUSTERED BY (`o_custkey`, `o_orderstatus`) SORTED BY (`o_custkey`, `o_orderstatus`) INTO 64 BUCKETS' || chr(10) || 'COMMENT ' || chr(39) || 'Orders of the shop, one row each' || chr(39) || ';' || chr(10) FROM f
UNION ALL SELECT 'schema.yaml', string_agg('- name: ' || name || chr(10) || '  type: ' || kind || chr(10) || '  mode: ' || mode || chr(10) || '  description: ' || CASE WHEN contains(said, ': ') THEN chr(39) || said || chr(39) ELSE said END || chr(10), '' ORDER BY ord) FROM f
UNION ALL SELECT 'audit', 'tester orders csv WARN CREATE SUCCESS 1')
SELECT *, (SELECT count(*) FROM orders) AS read FROM t"""


def rename_map_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and final names of the columns of a CSV of orders, with the values they hold."""
    read = csv_source.read_csv(spark, written(_order_lines(spark, sf_dir), "order,orderDate,Total Price,total-price,from,2nd Status"), "orders", header_mode="PRESENT")
    request = Request("x", "orders", "sales", "dev", "raw", "gold")
    return renamed(csv_source.csv_fields(read, "orders"), request).select("ord", "raw_name", "name", "path", "data_type", "row_count")


RENAME_SQL = """SELECT CAST(ord AS INTEGER) AS ord, raw_name, name, name AS path, data_type, (SELECT count(*) FROM orders) AS row_count FROM (VALUES (0, 'order', 'sales_orders_gold_order', 'INTEGER'), (1, 'orderDate', 'order_date', 'INTEGER'),
  (2, 'Total Price', 'total_price', 'DECIMAL'), (3, 'total-price', 'total_price_2', 'DATE'), (4, 'from', 'sales_orders_gold_from', 'STRING'), (5, '2nd Status', '_2nd_status', 'STRING')) AS v(ord, raw_name, name, data_type)"""


QUERIES = {
    "csv_scan_orders": csv_scan_orders,
    "csv_fields_orders": csv_fields_orders,
    "csv_scan_semicolons": csv_scan_semicolons,
    "csv_single_column": csv_single_column,
    "csv_wrapped_lines": csv_wrapped_lines,
    "csv_width_report": csv_width_report,
    "csv_confirmed_fields": csv_confirmed_fields,
    "json_leaf_values": json_leaf_values,
    "json_record_fields": json_record_fields,
    "json_repeated_keys": json_repeated_keys,
    "json_blank_keys": json_blank_keys,
    "json_mixed_shapes": json_mixed_shapes,
    "layout_events": layout_events,
    "parquet_footers_orders": parquet_footers_orders,
    "infer_flags_and_numbers": inferred(FLAGS),
    "infer_times_and_dates": inferred(TIMES),
    "infer_shapes_and_ranges": inferred(SHAPES),
    "process_customer_csv": process_customer_csv,
    "process_artifacts_orders": process_artifacts_orders,
    "rename_map_orders": rename_map_orders,
}

ORACLES = {
    "csv_scan_orders": CSV_SCAN_SQL,
    "csv_fields_orders": CSV_FIELDS_SQL,
    "csv_scan_semicolons": CSV_SEMICOLON_SQL,
    "csv_single_column": CSV_SINGLE_SQL,
    "csv_wrapped_lines": CSV_WRAPPED_SQL,
    "csv_width_report": CSV_REPORT_SQL,
    "csv_confirmed_fields": CSV_CONFIRMED_SQL,
    "json_leaf_values": JSON_LEAF_SQL,
    "json_record_fields": JSON_FIELDS_SQL,
    "json_repeated_keys": JSON_REPEATED_SQL,
    "json_blank_keys": JSON_BLANK_SQL,
    "json_mixed_shapes": JSON_MIXED_SQL,
    "layout_events": LAYOUT_SQL,
    "parquet_footers_orders": FOOTER_SQL,
    "infer_flags_and_numbers": inferred_sql(FLAGS),
    "infer_times_and_dates": inferred_sql(TIMES),
    "infer_shapes_and_ranges": inferred_sql(SHAPES),
    "process_customer_csv": PROCESS_SQL,
    "process_artifacts_orders": _artifact_sql(),
    "rename_map_orders": RENAME_SQL,
}
