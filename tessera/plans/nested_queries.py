"""Registered queries over nested definitions: a brand is an entity, its types are lists of records, sizes records inside them, parts fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import governance, registry
from tessera.plans import render_rows
from tessera.plans.queries import _normalized_sql, _versions, table
from tessera.plans.rule_queries import _names
from tessera.sources.shared import shared_path

_KINDS = ("INTEGER", "STRING", "NUMERIC", "RANGE", "JSON")


def definitions(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """Fields by path. The second version has them in turned order; brands that end in 1 have other types deep inside, those that end in 2 lack a type."""
    size, key = F.col("p_size"), F.col("p_partkey")
    one = F.substring("p_brand", -1, 1)
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.lower("p_type").alias("a"), F.concat(F.lit("s"), size.cast("string")).alias("b"), F.concat(F.lit("p"), key.cast("string")).alias("c"), size.alias("size"), key.cast("int").alias("key"), one.alias("one"))
    if second:
        part = part.where((F.col("one") != "2") | (F.col("a") != "economy")).withColumn("key", -F.col("key"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("size") % 5 + 1).cast("int"))
    kind = F.when((F.col("one") == "1") & (F.col("size") % 10 == 1), "FLOAT").otherwise(kind) if second else kind
    said = F.when(F.col("size") % 4 == 0, F.concat(F.lit('a "part" | of size '), F.col("size").cast("string")))
    void = F.lit(None).cast("string")
    leaf = part.select("entity", F.col("key").alias("ord"), F.concat_ws(".", "a", "b", "c").alias("path"), F.lit(3).alias("depth"), F.col("c").alias("name"), kind.alias("type"), F.when(F.col("size") % 7 == 0, "REPEATED").otherwise("NULLABLE").alias("mode"), said.alias("description"))
    inner = part.groupBy("entity", "a", "b", "size").agg(F.min("key").alias("ord")).select("entity", "ord", F.concat_ws(".", "a", "b").alias("path"), F.lit(2).alias("depth"), F.col("b").alias("name"), F.lit("RECORD").alias("type"), F.when(F.col("size") % 2 == 0, "REPEATED").otherwise("NULLABLE").alias("mode"), void.alias("description"))
    outer = part.groupBy("entity", "a").agg(F.min("key").alias("ord")).select("entity", "ord", F.col("a").alias("path"), F.lit(1).alias("depth"), F.col("a").alias("name"), F.lit("RECORD").alias("type"), F.lit("REPEATED").alias("mode"), void.alias("description"))
    return leaf.unionByName(inner).unionByName(outer)


def _leaves(second: bool = False) -> str:
    kind = "['INTEGER', 'STRING', 'NUMERIC', 'RANGE', 'JSON'][p_size % 5 + 1]"
    kind = f"CASE WHEN right(p_brand, 1) = '1' AND p_size % 10 = 1 THEN 'FLOAT' ELSE {kind} END" if second else kind
    where = "WHERE NOT (right(p_brand, 1) = '2' AND p_type = 'ECONOMY')" if second else ""
    return f"""SELECT p_brand AS entity, lower(p_type) AS a, p_size, CASE WHEN p_size % 2 = 0 THEN 'REPEATED' ELSE 'NULLABLE' END AS bmode, {'-' if second else ''}p_partkey AS ord, 'p' || p_partkey AS name, {kind} AS kind,
  CASE WHEN p_size % 7 = 0 THEN 'REPEATED' ELSE 'NULLABLE' END AS mode, CASE WHEN p_size % 4 = 0 THEN 'a "part" | of size ' || p_size END AS said FROM part {where}"""


def _folded(leaf: str, b: str, a: str, between: str, order: str = "ord") -> str:
    """Three levels of texts; ``leaf``, ``b`` and ``a`` use what is inside as ``inside``."""
    return f"""l AS ({_leaves()}), l3 AS (SELECT *, {leaf} AS t FROM l),
l2 AS (SELECT entity, a, 's' || p_size AS name, bmode AS mode, min(ord) AS ord, string_agg(t, '{between}' ORDER BY {order}) AS inside FROM l3 GROUP BY entity, a, p_size, bmode),
l1 AS (SELECT entity, a AS name, min(ord) AS ord, string_agg({b}, '{between}' ORDER BY {order}) AS inside FROM l2 GROUP BY entity, a), l0 AS (SELECT entity, CAST(ord AS INTEGER) AS ord, {a} AS t FROM l1)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions(spark, sf_dir).withColumnRenamed("type", "bq_type")


_NAMED = f"""n AS (SELECT entity, {_normalized_sql("'shop_dev_zone' || left(split_part(entity, '#', -1), 1)")} AS dataset, {_normalized_sql("'shop_' || entity || '_gold'")} AS "table" FROM (SELECT DISTINCT p_brand AS entity FROM part))"""


def _choices(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partitioning of brands that end in 3 or 4, clustering of all."""
    names, end = rows.select("entity").distinct(), F.substring("entity", -1, 1)
    by = names.select("entity", F.when(end == "3", "COLUMN").when(end == "4", "INGESTION_TIME").alias("strategy"), F.when(end == "3", "made_at").alias("column"), F.when(end == "3", "TIMESTAMP").alias("column_type")).where("strategy is not null")
    return by, names.select("entity", F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit("y").alias("column")), F.struct(F.lit(1).alias("rank"), F.lit("x").alias("column")))).alias("c")).select("entity", "c.*")


def nested_ddl_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE statements with records in lists of records."""
    rows = _targets(spark, sf_dir)
    return render_rows.create_tables(rows, _names(rows), *_choices(rows))


_SAID = """coalesce(' OPTIONS(description="' || replace(said, '"', '\\"') || '")', '')"""
NESTED_DDL_SQL = f"""WITH {_folded(f"'`' || name || '` ' || CASE WHEN mode = 'REPEATED' AND kind = 'RANGE' THEN 'ARRAY<RANGE<DATE>>' WHEN mode = 'REPEATED' THEN 'ARRAY<' || kind || '>' WHEN kind = 'RANGE' THEN 'RANGE<DATE>' ELSE kind END || {_SAID}",
  "'`' || name || '` ' || CASE mode WHEN 'REPEATED' THEN 'ARRAY<STRUCT<' || inside || '>>' ELSE 'STRUCT<' || inside || '>' END", "'`' || name || '` ARRAY<STRUCT<' || inside || '>>'", ", ")}, {_NAMED}
SELECT entity, 'CREATE TABLE IF NOT EXISTS `' || dataset || '.' || "table" || '` (' || chr(10) || '  ' || string_agg(t, ',' || chr(10) || '  ' ORDER BY ord) || chr(10) || ')'
  || CASE right(entity, 1) WHEN '3' THEN chr(10) || 'PARTITION BY DATE(`made_at`)' WHEN '4' THEN chr(10) || 'PARTITION BY _PARTITIONTIME' ELSE '' END || chr(10) || 'CLUSTER BY `x`, `y`'
  || chr(10) || 'OPTIONS(' || chr(10) || '  description="Table of \\"' || entity || '\\""' || chr(10) || ');' AS ddl
FROM l0 JOIN n USING (entity) GROUP BY entity, dataset, "table\""""


def nested_spark_ddl_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE statements for Spark: nested types, a derived date to partition by, sorted buckets for clustering."""
    rows = _targets(spark, sf_dir)
    return render_rows.create_spark_tables(rows, _names(rows), *_choices(rows))


_SPARK_KIND = "CASE kind WHEN 'INTEGER' THEN 'BIGINT' WHEN 'NUMERIC' THEN 'DECIMAL(38,9)' WHEN 'RANGE' THEN 'STRUCT<start: DATE, end: DATE>' WHEN 'JSON' THEN 'VARIANT' ELSE kind END"
NESTED_SPARK_SQL = f"""WITH {_folded(f"'`' || name || '`: ' || CASE mode WHEN 'REPEATED' THEN 'ARRAY<' || {_SPARK_KIND} || '>' ELSE {_SPARK_KIND} END",
  "'`' || name || '`: ' || CASE mode WHEN 'REPEATED' THEN 'ARRAY<STRUCT<' || inside || '>>' ELSE 'STRUCT<' || inside || '>' END", "'`' || name || '` ARRAY<STRUCT<' || inside || '>>'", ", ")}, {_NAMED}
SELECT entity, 'CREATE TABLE IF NOT EXISTS `' || dataset || '`.`' || "table" || '` (' || chr(10) || '  ' || string_agg(t, ',' || chr(10) || '  ' ORDER BY ord)
  || CASE right(entity, 1) WHEN '3' THEN ',' || chr(10) || '  `made_at_date` DATE COMMENT ''Day of made_at, for partitioning''' ELSE '' END || chr(10) || ') USING parquet'
  || CASE right(entity, 1) WHEN '3' THEN chr(10) || 'PARTITIONED BY (`made_at_date`)' ELSE '' END || chr(10) || 'CLUSTERED BY (`x`, `y`) SORTED BY (`x`, `y`) INTO 64 BUCKETS'
  || chr(10) || 'COMMENT ''Table of "' || entity || '"'';' AS ddl
FROM l0 JOIN n USING (entity) GROUP BY entity, dataset, "table\""""


def nested_json_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each list of records as an object of the JSON schema, with the fields inside it."""
    return render_rows.column_json(_targets(spark, sf_dir).withColumn("range_element", F.when(F.col("bq_type") == "RANGE", "DATE")))


_OBJECT = """'{"name":"' || name || '","type":"' || {0} || '","mode":"' || {1} || '"' || {2} || '}'"""
NESTED_JSON_SQL = f"""WITH {_folded(_OBJECT.replace('{0}', 'kind').replace('{1}', 'mode').replace('{2}', '''coalesce(',"description":"' || replace(said, '"', '\\"') || '"', '') || CASE kind WHEN 'RANGE' THEN ',"rangeElementType":{"type":"DATE"}' ELSE '' END'''),
  _OBJECT.replace('{0}', "'RECORD'").replace('{1}', 'mode').replace('{2}', """',"fields":[' || inside || ']'"""), _OBJECT.replace('{0}', "'RECORD'").replace('{1}', "'REPEATED'").replace('{2}', """',"fields":[' || inside || ']'"""), ",")}
SELECT entity, ord, t AS json FROM l0"""


def nested_doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documentation's tables of columns, nested fields by their paths."""
    rows = _targets(spark, sf_dir)
    return render_rows.column_docs(rows, ("economy",)).join(rows.select("entity", "ord", "depth", "path"), ["entity", "ord"]).where(F.contains("line", F.concat(F.lit("| "), "path", F.lit(" |")))).select("entity", "path", "section", "line")


NESTED_DOC_SQL = f"""WITH l AS ({_leaves()}), r AS (SELECT entity, a || '.s' || p_size || '.' || name AS path, kind, mode, coalesce(replace(said, '|', '\\|'), '') AS said FROM l
  UNION ALL SELECT DISTINCT entity, a || '.s' || p_size, 'RECORD', bmode, '' FROM l UNION ALL SELECT DISTINCT entity, a, 'RECORD', 'REPEATED', '' FROM l)
SELECT entity, path, CASE WHEN path = 'economy' THEN 'System / Metadata Columns' ELSE 'Business Columns' END AS section, '| ' || path || ' | ' || kind || ' | ' || mode || ' | ' || said || ' |' AS line FROM r"""


def nested_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of both versions: turned order changes nothing, a type deep inside does."""
    old, new = (governance.digests(governance.with_nested(definitions(spark, sf_dir, second))) for second in (False, True))
    both = old.select("entity", F.col("schema_hash").alias("old_hash"), "columns").join(new.select("entity", F.col("schema_hash").alias("new_hash")), "entity")
    return both.withColumn("same", F.col("old_hash") == F.col("new_hash"))


def _hashed(second: bool) -> str:
    cell = lambda *c: "concat_ws(chr(31), " + ", ".join(c) + ")"
    inside = "sha256(string_agg(cell, chr(30) ORDER BY cell))"
    return f"""SELECT entity, {inside} AS hash, CAST(count(*) AS BIGINT) AS columns FROM (SELECT entity, {cell('a', "'RECORD'", "'REPEATED'", "''", inside)} AS cell FROM (
  SELECT entity, a, {cell("'s' || p_size", "'RECORD'", 'bmode', "''", inside)} AS cell FROM (SELECT entity, a, p_size, bmode, {cell('name', 'kind', 'mode', "coalesce(said, '')")} AS cell FROM ({_leaves(second)}))
  GROUP BY entity, a, p_size, bmode) GROUP BY entity, a) GROUP BY entity"""


NESTED_DIGEST_SQL = f"""WITH o AS ({_hashed(False)}), n AS ({_hashed(True)}) SELECT entity, o.hash AS old_hash, n.hash AS new_hash, o.columns, o.hash = n.hash AS same FROM o JOIN n USING (entity)"""


def nested_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between the versions: records whose fields changed deep inside, and removed ones."""
    old, new = (governance.with_nested(definitions(spark, sf_dir, second)) for second in (False, True))
    return governance.diff(old, new).select("entity", "name", "change", "breaking")


NESTED_DIFF_SQL = """SELECT DISTINCT p_brand AS entity, lower(p_type) AS name, CASE right(p_brand, 1) WHEN '1' THEN 'NON_BREAKING_MODIFICATION' ELSE 'REMOVE_COLUMN' END AS change, right(p_brand, 1) = '2' AS breaking
FROM part WHERE right(p_brand, 1) = '1' AND p_size % 10 = 1 OR right(p_brand, 1) = '2' AND p_type = 'ECONOMY'"""


def registry_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of nested schemas: two commits of all brands, the second under AUTO, a compaction between; what it holds of each version."""
    made = registry.Registry(spark, shared_path(spark, "registry"))
    made.put_all(definitions(spark, sf_dir))
    made.compact()
    made.put_all(definitions(spark, sf_dir, True))
    return registry.versions(made.rows()).select("entity", "version", "table_name", "schema_hash", "breaking", "summary", "states")


COMMIT_SQL = f"""WITH o AS ({_hashed(False)}), n AS ({_hashed(True)}), b AS (SELECT o.entity, o.hash AS a, n.hash AS b, o.columns > n.columns AS gone FROM o JOIN n USING (entity))
SELECT entity, 1 AS version, entity || '_v1' AS table_name, CASE WHEN gone THEN a ELSE b END AS schema_hash, false AS breaking, 'ADD_NULLABLE_COLUMN' || CASE WHEN a != b AND NOT gone THEN ',NON_BREAKING_MODIFICATION' ELSE '' END AS summary,
  CAST(CASE WHEN a != b AND NOT gone THEN 2 ELSE 1 END AS BIGINT) AS states FROM b
UNION ALL SELECT entity, 2, entity || '_v2', b, true, 'REMOVE_COLUMN', 1 FROM b WHERE gone"""


def ddl_migrations_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added columns of which some are lists: those are refused, with the reason."""
    old, new = _versions(spark, sf_dir)
    new = new.withColumn("mode", F.when(F.col("description").endswith("0"), "REPEATED").otherwise("NULLABLE"))
    return render_rows.migrations(governance.diff(old, new), _names(new))


def _modes_sql() -> str:
    from tessera.plans.rule_queries import _DIFF, _NAMES_SQL

    return f"""WITH {_DIFF}, {_NAMES_SQL.format('n')}, y AS (SELECT n.entity, n.name, n.type, n.description, CASE WHEN n.description LIKE '%0' THEN 'REPEATED' ELSE 'NULLABLE' END AS mode FROM n LEFT JOIN o USING (entity, name) WHERE o.type IS NULL)
SELECT entity, name, CASE WHEN mode = 'NULLABLE' THEN 'ALTER TABLE `' || dataset || '.' || "table" || '` ADD COLUMN `' || name || '` ' || type || ' OPTIONS(description="' || description || '");' END AS statement,
  CASE WHEN mode != 'NULLABLE' THEN name || ' is REPEATED; only a nullable column can be added' END AS refused FROM y JOIN names USING (entity)"""


QUERIES = {
    "nested_ddl_brands": nested_ddl_brands,
    "nested_spark_ddl_brands": nested_spark_ddl_brands,
    "nested_json_brands": nested_json_brands,
    "nested_doc_lines": nested_doc_lines,
    "nested_digests": nested_digests,
    "nested_changes": nested_changes,
    "registry_commits": registry_commits,
    "ddl_migrations_modes": ddl_migrations_modes,
}

ORACLES = {
    "nested_ddl_brands": NESTED_DDL_SQL,
    "nested_spark_ddl_brands": NESTED_SPARK_SQL,
    "nested_json_brands": NESTED_JSON_SQL,
    "nested_doc_lines": NESTED_DOC_SQL,
    "nested_digests": NESTED_DIGEST_SQL,
    "nested_changes": NESTED_DIFF_SQL,
    "registry_commits": COMMIT_SQL,
    "ddl_migrations_modes": _modes_sql(),
}
