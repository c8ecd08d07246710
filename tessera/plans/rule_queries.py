"""Registered queries of the rules that are not reached by the given tables' own columns: definitions derived from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import advice, fields, governance
from tessera.plans import render_rows
from tessera.plans.queries import (
    _DEFS, _DIFF, _FINAL, HINTS, _class_sql, _declared, _definitions, _fields_sql, _hits_sql, _normalized_sql, _partition_sql, _versions, table,
)
from tessera.sources.shared import shared_path
from tessera.standards import DECLARED_CLUSTER_NOTE, EMPTY_TABLE_TEXTS, METADATA_COLUMNS, METADATA_NAMES, NO_CLUSTERING, TIME_HINTS

# --- advice ------------------------------------------------------------------------------------------


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of feeds: a customer is one, with two time columns, a list and row counts from what was ordered."""
    feeds = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 200).cast("long").alias("row_count"))
    key = F.col("o_custkey")
    columns = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("id").alias("name"), F.lit("INTEGER").alias("data_type"), F.lit(False).alias("is_array")),
        F.struct(F.lit(1).alias("ord"), F.lit("updated").alias("name"), F.lit("TIMESTAMP").alias("data_type"), F.lit(False).alias("is_array")),
        F.struct(F.lit(2).alias("ord"), F.lit("event_dates").alias("name"), F.lit("DATE").alias("data_type"), F.lit(True).alias("is_array")),
        F.struct(F.lit(3).alias("ord"), F.when(key % 7 == 0, "note").otherwise("created_at").alias("name"), F.when(key % 5 == 0, "DATE").otherwise("TIMESTAMP").alias("data_type"), F.lit(False).alias("is_array")),
    )
    columns = F.when(key % 11 == 0, F.slice(columns, 1, 1)).otherwise(columns)
    zone = F.element_at(F.array(*map(F.lit, ("raw", "curated", "analytics", "lab"))), (key % 4 + 1).cast("int"))
    rows = feeds.select(F.concat_ws(".", zone, key.cast("string")).alias("entity"), "row_count", F.explode(columns).alias("c"))
    return rows.select("entity", "row_count", "c.*", F.lit(1).alias("depth"))


ADVICE_COLUMNS = ("entity", "strategy", "column", "column_type", "granularity", "estimated_partition_count", "cost_risk", "cost_note", "confidence")


def partition_advice_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioning of every feed by its own zone: by hour where rows are many and kept short, by ingestion where no time column is."""
    return advice.partition_advice(_feeds(spark, sf_dir), F.substring_index("entity", ".", 1)).select(*ADVICE_COLUMNS)


FEEDS_SQL = f"""WITH o AS (SELECT o_custkey AS k, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 200) AS BIGINT) AS n, ['raw', 'curated', 'analytics', 'lab'][o_custkey % 4 + 1] AS zone FROM orders GROUP BY o_custkey),
fields AS (SELECT k, 'updated' AS name, 'TIMESTAMP' AS data_type, 1 AS ord FROM o WHERE k % 11 != 0 UNION ALL SELECT k, CASE WHEN k % 7 = 0 THEN 'note' ELSE 'created_at' END, CASE WHEN k % 5 = 0 THEN 'DATE' ELSE 'TIMESTAMP' END, 3 FROM o WHERE k % 11 != 0),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE data_type WHEN 'DATE' THEN 0 ELSE 1 END, {_hits_sql(TIME_HINTS)} DESC, ord) AS r FROM fields),
p AS (SELECT o.*, b.name, b.data_type, CASE zone WHEN 'raw' THEN 90 WHEN 'curated' THEN 365 END AS days FROM o LEFT JOIN b ON b.k = o.k AND b.r = 1),
g AS (SELECT *, CASE WHEN data_type = 'TIMESTAMP' AND (days IS NULL OR days <= 180) AND (n >= 50000000 OR n / greatest(coalesce(days, 30), 1) >= 5000000) THEN 'HOUR' ELSE 'DAY' END AS granularity FROM p),
c AS (SELECT *, CAST(CASE granularity WHEN 'HOUR' THEN days * 24 ELSE days END AS INTEGER) AS parts FROM g)
SELECT zone || '.' || k AS entity, CASE WHEN name IS NULL THEN 'INGESTION_TIME' ELSE 'COLUMN' END AS strategy, name AS "column", data_type AS column_type, granularity, parts AS estimated_partition_count,
  CASE WHEN days IS NULL THEN 'HIGH' WHEN granularity = 'HOUR' THEN CASE WHEN parts <= 720 THEN 'LOW' WHEN parts <= 4320 THEN 'MEDIUM' ELSE 'HIGH' END WHEN parts <= 120 THEN 'LOW' WHEN parts <= 730 THEN 'MEDIUM' ELSE 'HIGH' END AS cost_risk,
  CASE WHEN days IS NULL THEN 'No retention policy set for this zone. Define retention to control long-term cost.' ELSE 'Retention and estimated partition count are within expected cost bounds.' END AS cost_note,
  CASE WHEN name IS NULL THEN 'LOW' WHEN data_type = 'DATE' OR granularity = 'HOUR' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM c"""


def partition_advice_own_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioning by the tables' own columns, metadata columns left aside."""
    return advice.partition_advice(_declared(spark, sf_dir, counted=True), "raw", exclude_metadata=True).select(*ADVICE_COLUMNS)


OWN_PARTITION_SQL = f"""WITH {_fields_sql()}, best AS (SELECT entity, arg_min(name, ord) AS name FROM fields WHERE data_type = 'TIMESTAMP' AND name NOT IN ({', '.join(f"'{m}'" for m in METADATA_NAMES)}) GROUP BY entity)
SELECT e.entity, CASE WHEN b.name IS NULL THEN 'INGESTION_TIME' ELSE 'COLUMN' END AS strategy, b.name AS "column", CASE WHEN b.name IS NOT NULL THEN 'TIMESTAMP' END AS column_type, 'DAY' AS granularity, 90 AS estimated_partition_count,
  'LOW' AS cost_risk, 'Retention and estimated partition count are within expected cost bounds.' AS cost_note, CASE WHEN b.name IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS confidence
FROM (SELECT DISTINCT entity FROM fields) e LEFT JOIN best b USING (entity)"""


def cluster_outcomes_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is suggested for each size of part, and why not where nothing is; brands are its columns."""
    rows = table(spark, sf_dir, "part").groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("d"), F.min("p_partkey").alias("ord"))
    brand, size = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")), F.col("p_size")
    made = rows.select(
        F.concat(F.lit("size_"), size.cast("string")).alias("entity"), F.col("ord").cast("int").alias("ord"), F.lit(1).alias("depth"), F.lit(False).alias("is_array"),
        F.concat(brand, F.when(size % 5 == 0, "_amount").when(size % 5 == 1, "_status").when(size % 5 == 2, "_key").otherwise("_text")).alias("name"),
        F.when(size % 7 == 0, "DATE").otherwise("STRING").alias("data_type"), (F.col("d") / F.col("n") - F.when(size % 5 == 1, 0.99).otherwise(0.35)).alias("distinct_ratio"), F.lit(0.0).alias("null_ratio"),
    )
    return advice.cluster_outcomes(made, declared=True)


OUTCOME_SQL = f"""WITH r AS (SELECT p_size, p_brand, count(*) AS n, count(DISTINCT p_name) AS d, min(p_partkey) AS ord FROM part GROUP BY p_size, p_brand),
f AS (SELECT 'size_' || p_size AS entity, ord, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) || CASE p_size % 5 WHEN 0 THEN '_amount' WHEN 1 THEN '_status' WHEN 2 THEN '_key' ELSE '_text' END AS name, p_size,
  d / CAST(n AS DOUBLE) - CASE WHEN p_size % 5 = 1 THEN 0.99 ELSE 0.35 END AS ratio FROM r),
s AS (SELECT *, CAST(CASE WHEN ratio > 0.7 THEN 4 WHEN ratio < 0.05 THEN -3 ELSE 0 END + CASE WHEN contains(name, 'id') OR contains(name, 'key') THEN 1 WHEN contains(name, 'status') THEN -1 ELSE 0 END AS INTEGER) AS score FROM f WHERE p_size % 7 != 0 AND p_size % 5 != 0),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, ord) AS rank FROM s WHERE score > 0),
c AS (SELECT entity, string_agg(name, ',' ORDER BY rank) AS columns, max(score) AS best FROM k WHERE rank <= 4 GROUP BY entity)
SELECT e.entity, c.columns IS NOT NULL AS suggested, c.columns, CASE WHEN best >= 7 THEN 'HIGH' WHEN best >= 4 THEN 'MEDIUM' WHEN best IS NOT NULL THEN 'LOW' END AS confidence,
  CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.entity = e.entity) THEN '{NO_CLUSTERING["none eligible"]}' WHEN c.columns IS NULL THEN '{NO_CLUSTERING["low benefit"]}' END AS reason, '{DECLARED_CLUSTER_NOTE}' AS notes
FROM (SELECT DISTINCT entity FROM f) e LEFT JOIN c USING (entity)"""

# --- governance ----------------------------------------------------------------------------------------


def classify_subfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of nested fields, by their own names, and the summary of the records that hold them."""
    rows = _definitions(spark, sf_dir).select("entity", "ord", F.lit(2).alias("depth"), N.normalized(F.col("raw_name")).alias("name"), "data_type")
    rows = rows.withColumn("path", F.concat_ws(".", F.lit("detail"), "name")).withColumn("description", F.lit(None).cast("string"))
    return governance.classify(rows).select("entity", "ord", "path", "classification", "category", "confidence", "control")


SUBFIELD_SQL = f"""WITH {_DEFS}, f AS (SELECT entity, ord, {_normalized_sql('raw_name')} AS name, CAST(NULL AS VARCHAR) AS description FROM defs),
c AS ({_class_sql('f', "entity, ord, 'detail.' || name AS path")}) SELECT * FROM c"""


def validate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of tables: descriptions, numbers of columns, depth of records and what ranges hold."""
    line = table(spark, sf_dir, "lineitem")
    depth = (F.col("l_linenumber") * 3).cast("int")
    rows = line.select(
        F.col("l_returnflag").alias("entity"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("a column of the wide table").alias("description"),
        F.when(F.col("l_linestatus") == "F", "RANGE_DATE").otherwise("STRING").alias("data_type"), F.when(F.col("l_linestatus") == "F", "RANGE").otherwise("STRING").alias("bq_type"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, "TIME").when(F.col("l_linenumber") == 3, "TIMESTAMP").otherwise("DATE").cast("string").alias("range_element"), F.lit(1).alias("depth"),
    )
    nested = line.where("l_tax > 0.05").select(F.col("l_returnflag").alias("entity"), F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("name"), F.lit("a nested record").alias("description"), F.lit("RECORD").alias("data_type"), F.lit("RECORD").alias("bq_type"), F.lit(None).cast("string").alias("range_element"), (depth + 1).alias("depth"))
    made = rows.unionByName(nested).select("*", F.col("name").alias("path"), F.lit(None).cast("int").alias("precision"), F.lit(None).cast("int").alias("scale"))
    named = table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("entity"), F.element_at(F.array(F.lit("Table"), F.lit(""), F.lit(" tbd "), F.lit("short text"), F.lit("Customers and what they bought")), (F.col("c_custkey") % 5 + 1).cast("int")).alias("description"))
    flags = line.select(F.col("l_returnflag").alias("entity"), F.lit("Lines of orders by their return flag").alias("description")).distinct()
    return governance.violations(made, named.union(flags))


VALIDATE_SQL = f"""WITH t AS (SELECT 't' || c_custkey AS entity, ['Table', '', ' tbd ', 'short text', 'Customers and what they bought'][c_custkey % 5 + 1] AS said FROM customer)
SELECT entity, 'V2_TABLE_DESCRIPTION' AS rule, CAST(NULL AS VARCHAR) AS "column", CASE WHEN said = '' THEN 'missing' WHEN trim(lower(said)) IN ({', '.join(f"'{x}'" for x in EMPTY_TABLE_TEXTS)}) THEN 'not meaningful' ELSE 'too short' END AS detail FROM t WHERE length(trim(said)) < 20
UNION ALL SELECT entity, 'V4_COLUMN_COUNT', NULL, '0' FROM t
UNION ALL SELECT l_returnflag, 'V4_COLUMN_COUNT', NULL, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10000
UNION ALL SELECT l_returnflag, 'V3_DEPTH', 'n' || l_orderkey, CAST(l_linenumber * 3 + 1 AS VARCHAR) FROM lineitem WHERE l_tax > 0.05 AND l_linenumber * 3 + 1 > 13
UNION ALL SELECT l_returnflag, 'V5_RANGE', 'c' || l_orderkey || '_' || l_linenumber, CASE WHEN l_linenumber = 2 THEN 'TIME' END FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber IN (1, 2)
UNION ALL SELECT l_returnflag, 'V9_DUPLICATE', 'c' || l_orderkey || '_' || l_linenumber, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber HAVING count(*) > 1"""


def source_errors_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose columns use names of metadata columns, or have no others."""
    key, tail = F.col("p_partkey"), F.substring("p_brand", -1, 1)
    name = F.when((tail == "1") | ((tail == "2") & (key % 20 == 0)), F.when(key % 2 == 0, "_batch_id").otherwise("_OP_TS")).otherwise(F.col("p_name"))
    return fields.source_errors(table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), name.alias("raw_name"), F.lit(1).alias("depth")))


SOURCE_SQL = """WITH n AS (SELECT p_brand AS entity, CASE WHEN right(p_brand, 1) = '1' OR right(p_brand, 1) = '2' AND p_partkey % 20 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '_batch_id' ELSE '_OP_TS' END END AS reserved FROM part),
g AS (SELECT entity, count(*) FILTER (reserved IS NULL) AS own, string_agg(DISTINCT reserved, ', ' ORDER BY reserved) AS names FROM n GROUP BY entity)
SELECT entity, CASE WHEN own = 0 THEN 'only metadata columns' ELSE 'reserved column names: ' || names END AS error FROM g WHERE own = 0 OR names IS NOT NULL"""


def _with_ignored(rows: DataFrame) -> DataFrame:
    """Columns and one named like a metadata column, whose type differs between versions."""
    more = rows.select("entity").distinct().select("entity", F.lit("batch_id").alias("name"), F.lit("STRING").alias("type"), F.lit("NULLABLE").alias("mode"), F.lit("ignored").alias("description"))
    return rows.unionByName(more)


_HASH_SQL = """SELECT entity, sha256(string_agg(cell, chr(30) ORDER BY cell)) AS schema_hash, CAST(count(*) AS BIGINT) AS columns
  FROM (SELECT entity, concat_ws(chr(31), name, type, mode, description) AS cell FROM {}) GROUP BY entity"""


def schema_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of both versions of every brand, and whether they are the same; the order of columns and ignored names do not count."""
    old, new = (governance.digests(_with_ignored(v)) for v in _versions(spark, sf_dir))
    both = old.select("entity", F.col("schema_hash").alias("old_hash")).join(new, "entity", "full_outer")
    return both.select("entity", "old_hash", F.col("schema_hash").alias("new_hash"), "columns", F.col("old_hash").eqNullSafe(F.col("schema_hash")).alias("no_op"))


DIGEST_SQL = f"""WITH {_DIFF}, a AS ({_HASH_SQL.format('o')}), b AS ({_HASH_SQL.format('n')})
SELECT entity, a.schema_hash AS old_hash, b.schema_hash AS new_hash, b.columns, a.schema_hash IS NOT DISTINCT FROM b.schema_hash AS no_op FROM a FULL OUTER JOIN b USING (entity)"""


def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry in the shared folder: every brand's first version, then what AUTO appends for the second; its newest rows."""
    old, new = _versions(spark, sf_dir)
    path, none = shared_path(spark, "registry"), spark.createDataFrame([], "entity string, version int, schema_hash string")
    empty = old.select("entity", "name", "type", "mode", "description").limit(0)
    governance.next_versions(none, old, governance.diff(empty, old)).withColumn("at", F.lit(1)).write.parquet(path)
    known = governance.latest(spark.read.parquet(path))
    governance.next_versions(known, new, governance.diff(old, new)).withColumn("at", F.lit(2)).write.mode("append").parquet(path)
    return governance.latest(spark.read.parquet(path)).select("entity", "version", "schema_hash", "breaking", "summary")


REGISTRY_SQL = f"""WITH {_DIFF}, a AS ({_HASH_SQL.format('o')}), b AS ({_HASH_SQL.format('n')}),
s AS (SELECT entity, bool_or(breaking) AS breaking, string_agg(DISTINCT change, ',' ORDER BY change) AS summary FROM x GROUP BY entity)
SELECT entity, CAST(CASE WHEN a.entity IS NOT NULL AND coalesce(s.breaking, false) THEN 2 ELSE 1 END AS INTEGER) AS version, coalesce(b.schema_hash, a.schema_hash) AS schema_hash,
  CASE WHEN a.entity IS NULL OR a.schema_hash = b.schema_hash THEN false ELSE coalesce(s.breaking, false) END AS breaking,
  CASE WHEN a.schema_hash = b.schema_hash THEN 'ADD_NULLABLE_COLUMN' ELSE coalesce(s.summary, '') END AS summary
FROM a FULL OUTER JOIN b USING (entity) LEFT JOIN s USING (entity)"""


def drift_required_to_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes the other way round: from the second version to the first, ignored names included."""
    old, new = _versions(spark, sf_dir)
    return governance.diff(_with_ignored(new), old, fix_ignored=True).select("entity", "name", "change", "breaking")


BACK_SQL = f"""WITH {_DIFF}, m AS (SELECT * FROM n UNION ALL SELECT DISTINCT entity, 'batch_id', 'STRING', 'NULLABLE', 'ignored' FROM n),
y AS (SELECT entity, name, CASE WHEN m.type IS NULL THEN 'ADD_NULLABLE_COLUMN' WHEN o.type IS NULL THEN 'REMOVE_COLUMN' WHEN o.type != m.type THEN 'TYPE_CHANGE' WHEN o.mode != m.mode THEN 'REQUIRED_TO_NULLABLE' ELSE 'DESCRIPTION_CHANGE' END AS change
  FROM m FULL OUTER JOIN o USING (entity, name) WHERE (o.type, o.mode, o.description) IS DISTINCT FROM (m.type, m.mode, m.description))
SELECT entity, name, change, change IN ('REMOVE_COLUMN', 'TYPE_CHANGE') AS breaking FROM y"""

# --- texts ---------------------------------------------------------------------------------------------


def _names(rows: DataFrame) -> DataFrame:
    part = F.substring_index("entity", "#", -1)
    names = rows.select("entity").distinct()
    return names.select("entity", N.dataset_name(F.lit("shop"), F.lit("dev"), F.concat(F.lit("zone"), F.substring(part, 1, 1))).alias("dataset"), N.table_name(F.lit("shop"), F.col("entity"), F.lit("gold")).alias("table"), F.concat(F.lit('Table of "'), "entity", F.lit('"')).alias("description"))


_NAMES_SQL = f"""names AS (SELECT entity, {_normalized_sql("'shop_dev_zone' || left(split_part(entity, '#', -1), 1)")} AS dataset, {_normalized_sql("'shop_' || entity || '_gold'")} AS "table" FROM (SELECT DISTINCT entity FROM {{}}))"""


def dataset_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset and table names of every brand, and the statement that makes its dataset."""
    names = _names(_definitions(spark, sf_dir))
    return names.join(render_rows.create_schemas(names), "dataset").select("entity", "dataset", "table", "ddl")


IDENTITY_SQL = f"""WITH {_DEFS}, {_NAMES_SQL.format('defs')} SELECT entity, dataset, "table", 'CREATE SCHEMA IF NOT EXISTS `' || dataset || '`' || chr(10) || 'OPTIONS(location=''US'');' AS ddl FROM names"""


def ddl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE statements of the tables, partitioned and clustered as advised by their names."""
    rows = _declared(spark, sf_dir, counted=True)
    found = advice.partition_advice(rows, "raw")
    hints = spark.createDataFrame(HINTS, "entity string, name string, use string")
    rows = rows.withColumns({"distinct_ratio": F.lit(None).cast("double"), "null_ratio": F.lit(None).cast("double")})
    return render_rows.create_tables(rows, _names(rows), found, advice.cluster_advice(rows, found, hints))


def _ddl_sql() -> str:
    uses = ", ".join(f"('{e}', '{n}', '{u}')" for e, n, u in HINTS)
    S = advice.S
    return f"""WITH {_fields_sql()}, {_partition_sql()}, {_NAMES_SQL.format('fields')}, h(entity, name, use) AS (VALUES {uses}),
e AS (SELECT f.entity, f.ord, f.name, CAST(CASE WHEN {_hits_sql(S.HIGH_HINTS)} > 0 THEN 1 WHEN {_hits_sql(S.LOW_HINTS)} > 0 THEN -1 ELSE 0 END
    + coalesce((SELECT sum(CASE use WHEN 'joins' THEN 3 WHEN 'filters' THEN 2 ELSE 1 END) FROM h WHERE h.entity = f.entity AND h.name = f.name), 0) AS INTEGER) AS score
  FROM fields f WHERE data_type NOT IN ({', '.join(f"'{k}'" for k in S.UNCLUSTERABLE)}) AND name NOT IN ({', '.join(f"'{m}'" for m in METADATA_NAMES)}) AND {_hits_sql(S.METRIC_HINTS)} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, ord) AS rank FROM e WHERE score > 0),
c AS (SELECT entity, string_agg('`' || name || '`', ', ' ORDER BY rank) AS clusters FROM r WHERE rank <= 4 GROUP BY entity),
t AS (SELECT entity, string_agg('`' || name || '` ' || bq_type || CASE mode WHEN 'REQUIRED' THEN ' NOT NULL' ELSE '' END || ' OPTIONS(description="' || description || '")', ',' || chr(10) || '  ' ORDER BY ord) AS columns FROM fields GROUP BY entity)
SELECT entity, 'CREATE TABLE IF NOT EXISTS `' || dataset || '.' || "table" || '` (' || chr(10) || '  ' || columns || chr(10) || ')' || chr(10) || 'PARTITION BY DATE(`' || best.name || '`)' || coalesce(chr(10) || 'CLUSTER BY ' || clusters, '')
  || chr(10) || 'OPTIONS(' || chr(10) || '  description="Table of \\"' || entity || '\\""' || chr(10) || ');' AS ddl
FROM t JOIN names USING (entity) JOIN best USING (entity) LEFT JOIN c USING (entity) WHERE best.r = 1"""


def ddl_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALTER TABLE statements between two versions of every brand."""
    old, new = _versions(spark, sf_dir)
    return render_rows.migrations(governance.diff(old, new), _names(new)).select("entity", "name", "statement")


MIGRATION_SQL = f"""WITH {_DIFF}, {_NAMES_SQL.format('n')} SELECT entity, name, 'ALTER TABLE `' || dataset || '.' || "table" || '` ADD COLUMN `' || name || '` ' || n.type || ' OPTIONS(description="' || n.description || '");' AS statement
FROM x JOIN n USING (entity, name) JOIN names USING (entity) WHERE change = 'ADD_NULLABLE_COLUMN'"""


def _brand_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.with_final_names(_definitions(spark, sf_dir).withColumn("table_name", N.table_name(F.lit("parts"), F.col("entity"), F.lit("gold"))))
    rows = rows.select(
        "entity", "ord", "data_type", F.col("final_name").alias("name"), F.lit(1).alias("depth"), (F.col("p_size") % 9 == 0).alias("is_array"), F.lit(None).cast("long").alias("row_count"),
        F.when(F.col("p_size") % 4 == 0, "left | right").alias("description"), F.when(F.col("p_size") % 2 == 0, F.lit(12)).alias("precision"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") % 12).cast("int")).alias("scale"),
    )
    return fields.with_targets(fields.with_metadata_columns(rows))


_META = ", ".join(f"({i}, '{n}', '{k}', '{d.replace(chr(39), chr(39) * 2)}')" for i, (n, k, _, d) in enumerate(METADATA_COLUMNS))
_BRANDS_SQL = f"""{_DEFS}, {_FINAL}, brands AS (SELECT entity, ord, final_name AS name, CASE WHEN data_type = 'TIME' THEN 'STRING' WHEN data_type != 'DECIMAL' THEN data_type WHEN p_size % 2 = 0 AND p_size % 12 > 9 THEN 'BIGNUMERIC' ELSE 'NUMERIC' END AS bq_type,
    CASE WHEN p_size % 9 = 0 THEN 'REPEATED' ELSE 'NULLABLE' END AS mode,
    CASE WHEN p_size % 4 = 0 THEN 'left | right' ELSE upper(left(replace(final_name, '_', ' '), 1)) || substr(lower(replace(final_name, '_', ' ')), 2) || ' stored as ' || lower(data_type) || ' value. Nullable field.' END AS description FROM final
  UNION ALL SELECT e.entity, CAST(e.last + 1 + m.k AS INTEGER), m.name, m.data_type, 'REQUIRED', m.description FROM (SELECT entity, max(ord) AS last FROM defs GROUP BY entity) e, (VALUES {_META}) AS m(k, name, data_type, description))"""


def doc_columns_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the documentation's tables of columns, of every brand."""
    return render_rows.column_docs(_brand_fields(spark, sf_dir), METADATA_NAMES)


DOC_SQL = f"""WITH {_BRANDS_SQL} SELECT entity, ord, CASE WHEN name IN ({', '.join(f"'{m}'" for m in METADATA_NAMES)}) THEN 'System / Metadata Columns' ELSE 'Business Columns' END AS section,
  '| ' || name || ' | ' || bq_type || ' | ' || mode || ' | ' || replace(description, '|', '\\|') || ' |' AS line FROM brands"""


def json_schema_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column of every brand as an object of the JSON schema."""
    return render_rows.column_json(_brand_fields(spark, sf_dir))


JSON_SCHEMA_SQL = f"""WITH {_BRANDS_SQL} SELECT entity, ord, '{{"name":"' || name || '","type":"' || bq_type || '","mode":"' || mode || '","description":"' || description || '"}}' AS json FROM brands"""


def nested_record_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target types and modes of customers with their orders nested in lists of records, from the written file's schema."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").cast("decimal(38,12)").alias("total"), F.struct(F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority").alias("made"))).alias("orders")
    )
    made = table(spark, sf_dir, "customer").join(orders, "c_custkey").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("balance"), "orders", F.create_map("c_name", "c_nationkey").alias("codes"), F.array("c_mktsegment").alias("segments"))
    path = shared_path(spark, "nested") + ".parquet"
    made.write.parquet(path)
    from tessera.sources.declared import parquet_fields

    return fields.with_targets(parquet_fields(spark, path, "customer")).select("path", "depth", "data_type", "bq_type", "mode", "precision", "scale", "row_count")


NESTED_SQL = """SELECT path, CAST(depth AS INTEGER) AS depth, data_type, bq_type, mode, CAST(precision AS INTEGER) AS precision, CAST(scale AS INTEGER) AS scale, (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey) AS row_count
FROM (VALUES ('c_custkey', 1, 'INTEGER', 'INTEGER', 'NULLABLE', NULL, NULL), ('balance', 1, 'DECIMAL', 'NUMERIC', 'NULLABLE', 12, 2), ('orders', 1, 'RECORD', 'RECORD', 'REPEATED', NULL, NULL), ('orders.o_orderkey', 2, 'INTEGER', 'INTEGER', 'NULLABLE', NULL, NULL),
  ('orders.total', 2, 'DECIMAL', 'BIGNUMERIC', 'NULLABLE', 38, 12), ('orders.made', 2, 'RECORD', 'RECORD', 'NULLABLE', NULL, NULL), ('orders.made.day', 3, 'DATE', 'DATE', 'NULLABLE', NULL, NULL), ('orders.made.o_orderpriority', 3, 'STRING', 'STRING', 'NULLABLE', NULL, NULL),
  ('codes', 1, 'JSON', 'JSON', 'NULLABLE', NULL, NULL), ('segments', 1, 'STRING', 'STRING', 'REPEATED', NULL, NULL)) AS v(path, depth, data_type, bq_type, mode, precision, scale)"""


QUERIES = {
    "partition_advice_feeds": partition_advice_feeds,
    "partition_advice_own_columns": partition_advice_own_columns,
    "cluster_outcomes_brands": cluster_outcomes_brands,
    "classify_subfields": classify_subfields,
    "validate_tables": validate_tables,
    "source_errors_brands": source_errors_brands,
    "schema_digests": schema_digests,
    "registry_versions": registry_versions,
    "drift_required_to_nullable": drift_required_to_nullable,
    "dataset_identities": dataset_identities,
    "ddl_tables": ddl_tables,
    "ddl_migrations": ddl_migrations,
    "doc_columns_brands": doc_columns_brands,
    "json_schema_brands": json_schema_brands,
    "nested_record_targets": nested_record_targets,
}

ORACLES = {
    "partition_advice_feeds": FEEDS_SQL,
    "partition_advice_own_columns": OWN_PARTITION_SQL,
    "cluster_outcomes_brands": OUTCOME_SQL,
    "classify_subfields": SUBFIELD_SQL,
    "validate_tables": VALIDATE_SQL,
    "source_errors_brands": SOURCE_SQL,
    "schema_digests": DIGEST_SQL,
    "registry_versions": REGISTRY_SQL,
    "drift_required_to_nullable": BACK_SQL,
    "dataset_identities": IDENTITY_SQL,
    "ddl_tables": _ddl_sql(),
    "ddl_migrations": MIGRATION_SQL,
    "doc_columns_brands": DOC_SQL,
    "json_schema_brands": JSON_SCHEMA_SQL,
    "nested_record_targets": NESTED_SQL,
}
