"""Advice, classification, validation, drift and the registry."""

import itertools
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import advice, fields, governance
from tessera.operators.nesting import PATH_SCHEMA, path_rows
from tessera.operators.registry import Registry
from tessera.operators.registry import versions as registered
from tessera.plans import render_rows


def field_rows(spark, *rows, entity="e"):
    made = [(entity, i, n, 1, n, n, k, False, True, None, None, None, count, distinct, nulls) for i, (n, k, count, distinct, nulls) in enumerate(rows)]
    return spark.createDataFrame(made, fields.FIELD_SCHEMA + ", row_count long, distinct_ratio double, null_ratio double")


def test_partition_table(spark):
    def one(zone, *rows):
        r = advice.partition_advice(field_rows(spark, *rows), zone).first()
        return r.strategy, r.column, r.granularity, r.estimated_partition_count, r.cost_risk, r.confidence

    big = ("created_at", "TIMESTAMP", 60_000_000, None, None)
    assert one("raw", big) == ("COLUMN", "created_at", "HOUR", 2160, "MEDIUM", "HIGH")
    assert one("curated", big) == ("COLUMN", "created_at", "DAY", 365, "MEDIUM", "MEDIUM")
    assert one("raw", ("order_date", "DATE", 5, None, None), ("event_time", "TIMESTAMP", 5, None, None)) == ("COLUMN", "order_date", "DAY", 90, "LOW", "HIGH")
    assert one("analytics", ("a", "STRING", 5, None, None)) == ("INGESTION_TIME", None, "DAY", None, "HIGH", "LOW")


def test_cluster_scores(spark):
    rows = field_rows(spark, ("cust_id", "STRING", 9, 0.9, 0.0), ("status", "STRING", 9, 0.01, 0.7), ("amount", "STRING", 9, 0.9, 0.0), ("note", "STRING", 9, 0.8, 0.0), ("ratio", "FLOAT", 9, 0.9, 0.0))
    hints = spark.createDataFrame([("e", "cust_id", "joins"), ("e", "cust_id", "filters")], "entity string, name string, use string")
    got = [(r.column, r.score, r.confidence) for r in advice.cluster_advice(rows, hints=hints).orderBy("rank").collect()]
    assert got == [("cust_id", 10, "HIGH"), ("note", 4, "HIGH")]


def test_classes(spark):
    want = {"user_email": "PII.EMAIL", "dob": "PII.DOB", "ssn_hash": "PII.NATIONAL_ID", "api_key": "SENSITIVE.TOKEN", "encryption_key": "SENSITIVE.SECURITY", "order_key": "UNKNOWN", "amount": "NON_PII", "_record_hash": "NON_PII"}
    rows = spark.createDataFrame([(n,) for n in want], "name string").withColumn("description", fields.described(F.col("name"), F.lit("STRING")))
    got = governance.classify(rows).collect()
    assert {r["name"]: r.classification for r in got} == want
    assert {r["name"]: r.confidence for r in got}["_record_hash"] == "HIGH"


def versions(spark, **columns):
    rows = [("e", n, *v) for n, v in columns.items()]
    return spark.createDataFrame(rows, "entity string, name string, type string, mode string, description string")


def test_every_change(spark):
    base = ("STRING", "NULLABLE", "d")
    old = versions(spark, a=base, b=base, c=("STRING", "REQUIRED", "d"), d=base, gone=base, same=base, batch_id=base)
    new = versions(spark, a=("INTEGER", "NULLABLE", "d"), b=("STRING", "REQUIRED", "d"), c=base, d=("STRING", "NULLABLE", "x"), same=base, more=base, must=("STRING", "REQUIRED", "d"), batch_id=("INTEGER", "NULLABLE", "d"))
    got = {r["name"]: (r.change, r.breaking) for r in governance.diff(old, new).collect()}
    assert got == {
        "a": ("TYPE_CHANGE", True), "b": ("NULLABLE_TO_REQUIRED", True), "c": ("REQUIRED_TO_NULLABLE", False), "d": ("DESCRIPTION_CHANGE", False),
        "gone": ("REMOVE_COLUMN", True), "more": ("ADD_NULLABLE_COLUMN", False), "must": ("ADD_REQUIRED_COLUMN", True),
    }
    assert "batch_id" in {r["name"] for r in governance.diff(old, new, fix_ignored=True).collect()}


def test_decision_table(spark):
    base = versions(spark, a=("STRING", "NULLABLE", "d"))
    kinds = {"NO_OP": base, "NON_BREAKING": versions(spark, a=("STRING", "NULLABLE", "x")), "BREAKING": versions(spark, a=("INTEGER", "NULLABLE", "d"))}
    known = spark.createDataFrame([("e", 4)], "entity string, version int")
    for (decision, new), policy in itertools.product(kinds.items(), ("STRICT", "WARN", "AUTO")):
        r = governance.decisions(known, new, governance.diff(base, new), policy).first()
        status = {"STRICT": "REFUSED", "WARN": "WARNING", "AUTO": "SUCCESS"}[policy] if decision == "BREAKING" else "SUCCESS"
        assert (r.decision, r.status, r.version) == (decision, status, 5 if decision == "BREAKING" and policy == "AUTO" else 4)
    r = governance.decisions(known.limit(0), base, governance.diff(base.limit(0), base), "STRICT").first()
    assert (r.decision, r.version) == ("CREATE", 1)


def test_violations(spark):
    rows = fields.with_targets(field_rows(spark, ("Bad-Name", "STRING", 1, None, None), ("x" * 301, "STRING", 1, None, None), ("a", "DECIMAL", 1, None, None), ("A", "STRING", 1, None, None), ("ok_name", "STRING", 1, None, None)))
    rows = rows.withColumn("description", F.when(F.col("name") == "ok_name", "a fine description").when(F.col("name") == "a", "todo").otherwise("short"))
    got = {(r.rule, r.column) for r in governance.violations(rows, spark.createDataFrame([("e", "data")], "entity string, description string")).collect()}
    assert got >= {("V6_NAME_FORMAT", "Bad-Name"), ("V6_NAME_LENGTH", "x" * 301), ("V1_DECIMAL", "a"), ("V9_DUPLICATE", "a"), ("V8_DESCRIPTION", "a"), ("V2_TABLE_DESCRIPTION", None)}
    assert not any(c == "ok_name" for _, c in got)
    with pytest.raises(governance.SchemaInvalid):
        governance.check(rows)


def test_wide_table_breaks_no_rule_of_columns(spark):
    many = spark.range(10_001).select(F.lit("e").alias("entity"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"), F.lit("a fine description").alias("description"), F.lit("STRING").alias("data_type"))
    rows = many.select("*", F.col("name").alias("path"), F.lit(1).alias("depth"), F.col("data_type").alias("bq_type"), *(F.lit(None).cast("int").alias(c) for c in ("precision", "scale")), F.lit(None).cast("string").alias("range_element"))
    assert [tuple(r) for r in governance.violations(rows).collect()] == [("e", "V4_COLUMN_COUNT", None, "10001")]
    assert governance.column_violations(rows).count() == 0
    with pytest.raises(governance.SchemaInvalid, match="V4_COLUMN_COUNT"):
        governance.check(rows)


def columns(**kinds):
    return [{"name": n, "type": k, "mode": "NULLABLE", "description": "d"} for n, k in kinds.items()]


def nested(spark, schema, entity="e"):
    return spark.createDataFrame(path_rows(entity, schema), PATH_SCHEMA)


RECORDS = [
    {"name": "id", "type": "INTEGER", "mode": "REQUIRED", "description": 'the "id"'}, {"name": "tags", "type": "STRING", "mode": "REPEATED"},
    {"name": "a.b", "type": "RECORD", "mode": "REPEATED", "fields": [
        {"name": "x", "type": "DATE", "mode": "REQUIRED", "description": "is NOT NULL"},
        {"name": "in", "type": "RECORD", "mode": "REPEATED", "fields": [{"name": "y.z", "type": "FLOAT", "mode": "NULLABLE"}, {"name": "w", "type": "JSON", "mode": "REPEATED"}]}]},
    {"name": "p", "type": "RANGE", "mode": "NULLABLE", "rangeElementType": {"type": "DATE"}},
]


def test_digest_of_nested_fields(spark):
    turned = [dict(c, fields=[dict(f, fields=f["fields"][::-1]) if "fields" in f else f for f in c["fields"]][::-1]) if "fields" in c else c for c in RECORDS][::-1]
    digest = governance.digest_of(nested(spark, RECORDS))
    assert digest == governance.digest_of(nested(spark, turned))
    other = json.loads(json.dumps(RECORDS))
    other[2]["fields"][1]["fields"][1]["type"] = "STRING"
    assert digest != governance.digest_of(nested(spark, other))
    changes = governance.diff(governance.with_nested(nested(spark, RECORDS)), governance.with_nested(nested(spark, other))).collect()
    assert [(c["name"], c.change) for c in changes] == [("a.b", "NON_BREAKING_MODIFICATION")]
    held = governance.recorded(governance.with_nested(nested(spark, RECORDS)))
    assert held.first().schema_hash == digest == governance.digests(governance.known_columns(held)).first().schema_hash
    made = governance.with_nested(nested(spark, RECORDS)).orderBy("ord").collect()
    assert [c["name"] for c in json.loads(made[2].schema)["fields"]] == ["x", "in"]


def test_registry(spark, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}/registry")
    a, b = columns(x="STRING"), columns(x="INTEGER")
    assert [registry.put("e", a), registry.put("e", a), registry.put("e", b), registry.put("e", a, in_place=True, summary="back"), registry.put("f", a), registry.put("n", RECORDS)] == [1, 1, 2, 2, 1, 1]
    assert registry.current("e").schema_hash == governance.digest_of(nested(spark, a))
    before = {(r.entity, r.version): (r.schema_hash, r.summary, r.states) for r in registered(registry.rows()).collect()}
    assert before["e", 2][1:] == ("back", 2) and len(before) == 4
    registry.compact()
    registry.put("g", b)
    assert registry.clean() == 5 and registry.clean() == 0
    after = {(r.entity, r.version): (r.schema_hash, r.summary, r.states) for r in registered(registry.rows()).collect()}
    assert {k: v for k, v in after.items() if k[0] != "g"} == before and ("g", 1) in after


def test_registry_of_many_entities(spark, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}/registry")
    both = lambda *s: nested(spark, s[0]).unionByName(nested(spark, s[1], "f"))
    assert registry.put_all(both(RECORDS, columns(x="STRING"))) == 2
    assert registry.put_all(both(RECORDS[::-1], columns(x="STRING"))) == 0
    assert registry.put_all(both(RECORDS[1:], columns(x="STRING", y="DATE")), "STRICT") == 1
    assert registry.put_all(both(RECORDS[1:], columns(x="STRING", y="DATE"))) == 1
    got = {(r.entity, r.version): (r.breaking, r.summary, r.table_name) for r in registered(registry.rows()).collect()}
    assert got == {("e", 1): (False, "ADD_NULLABLE_COLUMN,ADD_REQUIRED_COLUMN", "e_v1"), ("e", 2): (True, "REMOVE_COLUMN", "e_v2"), ("f", 1): (False, "ADD_NULLABLE_COLUMN,ADD_NULLABLE_COLUMN", "f_v1")}
    assert json.loads(registry.current("f").schema)[1]["name"] == "y"


def test_writers_at_once(spark, tmp_path):
    """Writers of one entity each get their own version, and those of others lose none."""
    path = f"file://{tmp_path}/registry"
    Registry(spark, path).put("e", columns(x="STRING"))
    with ThreadPoolExecutor(4) as pool:
        own = [pool.submit(lambda n=n: Registry(spark, path).put("e", columns(**{f"x{n}": "STRING"}), True)) for n in range(4)]
        others = [pool.submit(lambda n=n: Registry(spark, path).put(f"o{n}", columns(x="STRING"))) for n in range(4)]
        assert sorted(f.result() for f in own) == [2, 3, 4, 5] and [f.result() for f in others] == [1] * 4
    rows = Registry(spark, path).rows().collect()
    assert len(rows) == 9 and len({(r.entity, r.version) for r in rows}) == 9 and sorted(r.entry for r in rows) == list(range(1, 10))
    registry = Registry(spark, path)
    assert not registry._publish(3, {"folder": "x", "whole": False}) and registry._publish(10, {"folder": "rows-none", "whole": False})


def target(spark, schema, entity="e"):
    return nested(spark, schema, entity).withColumnRenamed("type", "bq_type")


def test_statements(spark):
    rows = target(spark, RECORDS)
    names = spark.createDataFrame([("e", "d", "t", "it's about")], "entity string, dataset string, table string, description string")
    by = spark.createDataFrame([("e", "COLUMN", "ts", "TIMESTAMP")], "entity string, strategy string, column string, column_type string")
    within = spark.createDataFrame([("e", 1, "id")], "entity string, rank int, column string")
    assert render_rows.create_tables(rows, names, by, within).first().ddl == (
        'CREATE TABLE IF NOT EXISTS `d.t` (\n  `id` INTEGER NOT NULL OPTIONS(description="the \\"id\\""),\n  `tags` ARRAY<STRING>,\n'
        '  `a.b` ARRAY<STRUCT<`x` DATE OPTIONS(description="is NOT NULL"), `in` ARRAY<STRUCT<`y.z` FLOAT, `w` ARRAY<JSON>>>>>,\n'
        '  `p` RANGE<DATE>\n)\nPARTITION BY DATE(`ts`)\nCLUSTER BY `id`\nOPTIONS(\n  description="it\'s about"\n);'
    )
    assert "PARTITION" not in render_rows.create_tables(rows, names, by.withColumn("column_type", F.lit("INTEGER")), within).first().ddl
    assert [json.loads(r.json) for r in render_rows.column_json(rows).orderBy("ord").collect()] == RECORDS
    text = render_rows.create_spark_tables(rows, names, by.withColumn("column", F.lit("id")), within).first().ddl
    assert "CLUSTERED BY (`id`) SORTED BY (`id`) INTO 64 BUCKETS" in text
    spark.sql("create schema if not exists d")
    spark.sql(text.rstrip(";").replace("ARRAY<VARIANT>", "ARRAY<STRING>"))
    assert dict(spark.table("d.t").dtypes)["a.b"] == "array<struct<x:date,in:array<struct<y.z:double,w:array<string>>>>>"
    changes = spark.createDataFrame([("e", n, "ADD_NULLABLE_COLUMN", "STRING", m, "d") for n, m in (("n", "NULLABLE"), ("r", "REPEATED"))], "entity string, name string, change string, new_type string, new_mode string, new_description string")
    assert [tuple(r) for r in render_rows.migrations(changes, names).orderBy("name").collect()] == [("e", "n", 'ALTER TABLE `d.t` ADD COLUMN `n` STRING OPTIONS(description="d");', None), ("e", "r", None, "r is REPEATED; only a nullable column can be added")]
    with pytest.raises(Exception, match="no fields"):
        render_rows.create_tables(target(spark, [{"name": "r", "type": "RECORD", "mode": "NULLABLE"}]), names, by, within).collect()
    docs = [(r.section, r.line) for r in render_rows.column_docs(rows, ("id",)).orderBy("ord").collect()]
    assert docs[0][0] == "System / Metadata Columns" and docs[5] == ("Business Columns", "| a.b.in.y.z | FLOAT | NULLABLE |  |")
