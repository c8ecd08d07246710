"""Whole runs over files of each format."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.cli import request_of
from tessera.operators import governance
from tessera.plans.process import Request, process, write_artifacts
from tessera.sources import csv_source, declared, json_source
from tessera.sources.detect import detect_format

CSV = """# a comment
id,active,code01,price,ratio,ts,d,geo,period,note

1,yes,0,10.50,1e-3,2024-01-01T10:00:00Z,2024-01-05,POINT(1 2),"[2024-01-01,2024-02-01)",hello
2,no,1,3.125,2.5,2024-01-02T11:30:00+05:30,31-12-2023,POINT(3 4),"[2024-02-01,2024-03-01)",
"""
JSON = """{"id":1,"user":{"name":"A","age":30},"tags":["x","y"],"items":[{"sku":"a","qty":1}],"empty":[]}
not json
{"id":2,"user":{"name":"B"},"tags":[],"items":[{"sku":"b","qty":2}],"empty":[]}
"""


def request(path, **more):
    base = {"path": str(path), "entity": "sales", "domain": "finance", "environment": "dev", "zone": "raw", "layer": "gold", "table_description": "Sales of the shop, by line."}
    return Request(**(base | more))


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return tmp_path / name


def test_csv_types(spark, tmp_path):
    table = csv_source.read_csv(spark, str(put(tmp_path, "a.csv", CSV)), "sales", header_mode="PRESENT", mode="SPLIT", delimiter=",")
    got = {r["name"]: r.data_type for r in csv_source.csv_fields(table, "sales").collect()}
    assert got == {"id": "INTEGER", "active": "BOOLEAN", "code01": "INTEGER", "price": "DECIMAL", "ratio": "FLOAT", "ts": "TIMESTAMP", "d": "DATE", "geo": "GEOGRAPHY", "period": "RANGE_DATE", "note": "STRING"}


def test_csv_structure(spark, tmp_path):
    short = str(put(tmp_path, "b.csv", "a,,c\n1,2\n1,2,3\n1,2,3,4\n"))
    table = csv_source.read_csv(spark, short, "sales", header_mode="PRESENT", mode="SPLIT", delimiter=",")
    assert table.names == ["a", "sales_2", "c"]
    bad = {r.line: (r.missing_columns, r.extra_values) for r in table.mismatches.collect()}
    assert bad == {"1,2": (["c"], []), "1,2,3,4": ([], ["4"])}
    out = process(spark, request(short, csv={"header_mode": "PRESENT"}))
    assert out["status"] == "ROW_WIDTH_MISMATCH" and out["confirm_required"]
    kept = {r["name"]: (r.data_type, r.nullable) for r in csv_source.csv_fields(table, "sales", confirmed=True).collect()}
    assert kept["c"] == ("STRING", False)
    for text, message in (('a,b\n1,"2\n', "quotes"), ("a,b;c\n1,2\n", "mixes"), ("t,u\n2024-01-01 10:00:00,x\n", "without zone")):
        path = str(put(tmp_path, "c.csv", text))
        with pytest.raises(ValueError, match=message):
            csv_source.csv_fields(csv_source.read_csv(spark, path, "e", header_mode="PRESENT", mode="SPLIT", delimiter=","), "e")
    with pytest.raises(ValueError, match="header"):
        csv_source.read_csv(spark, str(put(tmp_path, "d.csv", "1,2,3\n4,5,6\n")), "e", header_mode="ABSENT")
    wrapped = csv_source.read_csv(spark, str(put(tmp_path, "e.csv", '"a,b"\n"1,2"\n')), "e", remove_quotes=True, header_mode="PRESENT")
    assert wrapped.names == ["a", "b"] and wrapped.rows.first().asDict() == {"a": "1", "b": "2"}
    doubled = csv_source.read_csv(spark, str(put(tmp_path, "f.csv", '"a,b"\n"1,""x, y"""\n')), "e", remove_quotes=True, header_mode="PRESENT")
    assert doubled.rows.first().asDict() == {"a": "1", "b": "x, y"}
    with pytest.raises(ValueError, match="header mode"):
        csv_source.read_csv(spark, short, "e", header_mode="MAYBE")
    with pytest.raises(ValueError, match="cannot be set"):
        csv_source.csv_fields(table, "e", overrides={"a": "GEOGRAPHY"})
    assert {r["name"]: r.data_type for r in csv_source.csv_fields(table, "e", overrides={"A": "STRING"}).collect()}["a"] == "STRING"


def test_a_run_reads_each_line_twice(spark, tmp_path, monkeypatch):
    """Once to check it and once for the profile; the first lines are looked at before."""
    seen = spark.sparkContext.accumulator(0)

    def count(line):
        seen.add(1)
        return line

    counted, clean = F.udf(count, "string").asNondeterministic(), csv_source.clean_lines
    monkeypatch.setattr(csv_source, "clean_lines", lambda *a: clean(*a).withColumn("line", counted("line")))
    path = put(tmp_path, "many.csv", "id,day,note\n" + "".join(f"{i},2024-01-{i % 28 + 1:02},text {i}\n" for i in range(2000)))
    out = process(spark, request(path, csv={"header_mode": "PRESENT"}, preview=True))
    assert (out["status"], out["partitioning"]["column"], [c["column"] for c in out["clustering"]]) == ("PREVIEW", "day", ["id", "note"])
    assert 2 * 2001 <= seen.value <= 3 * 2001


def test_csv_headers_of_files_in_blocks(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for name, mark in (("a", "\ufeff"), ("b", "")):
        put(tmp_path / "many", f"{name}.csv", mark + "\n# note\na,b\n" + "".join("a,b\n" if i % 7 == 0 else f'{name}{i},"{i},"""\n' for i in range(60)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    try:
        table = csv_source.read_csv(spark, str(tmp_path / "many"), "e", header_mode="PRESENT")
        assert table.rows.rdd.getNumPartitions() > 4 and table.uneven == 0
        assert sorted(tuple(r) for r in table.rows.collect()) == sorted(("a", "b") if i % 7 == 0 else (f"{n}{i}", f'{i},"') for n in "ab" for i in range(60))
        put(tmp_path / "many", "c.csv", "a,b\n" + "1,2\n" * 60 + '3,"x\n' + "4,5\n" * 60)
        with pytest.raises(ValueError, match='unbalanced quotes: 3,"x$'):
            csv_source.read_csv(spark, str(tmp_path / "many"), "e", header_mode="PRESENT")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_csv_lines_like_the_header_are_data(spark, tmp_path):
    path = put(tmp_path, "h.csv", '# first\na,b,c\n1,2,3\na,b,c\n"x,1",2\n\n1,"q ""z"" y",3,4,5\n')
    table = csv_source.read_csv(spark, str(path), "e", header_mode="PRESENT")
    assert [tuple(r) for r in table.rows.collect()] == [("1", "2", "3"), ("a", "b", "c"), ("x,1", "2", None), ("1", 'q "z" y', "3")]
    wrong = [(r.row_number, r.expected, r.actual, r.missing_columns, r.extra_values, r.mapped_preview["c"]) for r in table.mismatches.orderBy("row_number").collect()]
    assert wrong == [(4, 3, 2, ["c"], [], "<MISSING>"), (5, 3, 5, [], ["4", "5"], "3")]
    one = csv_source.read_csv(spark, str(put(tmp_path, "s.csv", "v\n1\nv\n")), "e", mode="SINGLE", header_mode="PRESENT")
    assert [r.v for r in one.rows.collect()] == ["1", "v"]
    long = ",".join('"a,b"' for _ in range(20000))
    assert spark.range(1).select(csv_source.width(F.lit(long), ","), F.size(csv_source.cells_of(F.lit(long), ","))).first()[:] == (20000, 20000)


def test_json_constants_in_strings_and_repeated_keys(spark, tmp_path):
    text = '{"a": "ratio: NaN, so", "b": 1.50}\n{"a": 1, "a": [{"x": 2e3, "x": "é"}], "a": null}\nbroken\n'
    got = [r.asDict(True) for r in json_source.read_json(spark, str(put(tmp_path, "d.jsonl", text))).orderBy("b").collect()]
    assert got[1]["a"] == "ratio: NaN, so" and got[1]["b"] == "1.50" and got[0]["a"] == "1" and got[0]["a_2"] == [{"x": "2e3", "x_2": "é"}]
    whole = json_source.read_json(spark, str(put(tmp_path, "w.json", '[{"a": 1, "a": 2},\n {"a": 3}]')))
    assert {(r.a, r.a_2) for r in whole.collect()} == {("1", "2"), ("3", None)}
    with pytest.raises(ValueError, match="NaN"):
        json_source.read_json(spark, str(put(tmp_path, "i.jsonl", '{"a": "x"}\n{"a": [1, -Infinity]}\n')))


def test_json_blank_and_dotted_keys(spark, tmp_path):
    text = '{"a": 1, "": 2, "in": {" ": [{"x.y": 1.5, "x": {"y": "text"}}]}, " b ": "s, \\"\\": {"}\n{"a": 3, "": 4, "in": null}\n'
    df = json_source.read_json(spark, str(put(tmp_path, "b.jsonl", text)), entity="sale")
    got = {(r.path, r.depth): (r.data_type, r.cells) for r in json_source.json_fields("sale", df).collect()}
    assert got == {
        ("a", 1): ("INTEGER", 2), ("sale_2", 1): ("INTEGER", 2), ("b", 1): ("STRING", 2), ("in", 1): ("RECORD", None), ("in.sale_1", 2): ("RECORD", None), ("in.sale_1.x", 3): ("RECORD", None),
        ("in.sale_1.x.y", 4): ("STRING", 1), ("in.sale_1.x.y", 3): ("DECIMAL", 1),
    }
    whole = json_source.read_json(spark, str(put(tmp_path, "b.json", '[{"": 1},\n {"": 2, "`c": 3}]')), entity="sale")
    assert {(r["sale_1"], r["`c"]) for r in whole.collect()} == {("1", None), ("2", "3")}
    assert json_source.leaf_cells(whole).count() == 4
    out = process(spark, request(put(tmp_path, "p.jsonl", text)))
    assert {"a", "sales_2", "b", "in"} <= {c["name"].removeprefix("finance_sales_gold_") for c in out["columns"]}


def test_config_of_either_shape(spark, tmp_path):
    path = str(put(tmp_path, "c.csv", "id;note\n1;x\n2;y\n"))
    made = request_of({
        "entity": "sales", "domain": "finance", "environment": "dev", "zone": "raw", "layer": "gold", "output": "DDL", "source": {"file_path": path, "csv_override": {"mode": "SPLIT", "delimiter": ";", "header_mode": "PRESENT"}},
        "settings": {"drift_policy": "AUTO", "table_description": "Sales of the shop, by line.", "type_overrides": {"id": "STRING"}}, "partitioning": {"mode": "MANUAL", "strategy": "COLUMN", "column": "day", "column_type": "DATE"}, "clustering": {"mode": "MANUAL", "columns": ["id"]},
    })
    assert (made.path, made.policy, made.output_type, made.csv["delimiter"], made.cluster_override, made.user_id) == (path, "AUTO", "DDL", ";", ["id"], "config_executor")
    text = process(spark, made)["artifacts"]["create_table.sql"]
    assert "`id` STRING" in text and "PARTITION BY `day`" in text and "CLUSTER BY `id`" in text
    skipped = request_of({"entity": "e", "source": {"file_path": "x.csv"}, "partitioning": {"mode": "SKIP"}, "clustering": {"mode": "SKIP"}})
    assert (skipped.partition_override, skipped.cluster_override, skipped.policy, skipped.output_type) == ("SKIP", [], "WARN", "ALL_FORMATS")
    assert request_of({"path": path, "entity": "e", "domain": "d", "environment": "e", "zone": "z", "layer": "l"}).cluster_override is None
    with pytest.raises(ValueError, match="colour"):
        request_of({"entity": "e", "source": {"file_path": "x.csv"}, "colour": 1})


def test_artifacts_of_an_earlier_run_go(tmp_path):
    (tmp_path / "migration.sql").write_text("old")
    (tmp_path / "own.txt").write_text("kept")
    assert write_artifacts({"artifacts": {"schema.json": "[]"}}, str(tmp_path)) == ["run_summary.json", "schema.json"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["own.txt", "run_summary.json", "schema.json"]


def test_json(spark, tmp_path):
    df = json_source.read_json(spark, str(put(tmp_path, "a.jsonl", JSON)))
    got = {r.path: (r.data_type, r.is_array) for r in json_source.json_fields("e", df).collect()}
    assert got == {
        "id": ("INTEGER", False), "user": ("RECORD", False), "user.name": ("STRING", False), "user.age": ("INTEGER", False), "tags": ("STRING", True),
        "items": ("RECORD", True), "items.sku": ("STRING", False), "items.qty": ("INTEGER", False), "empty": ("STRING", True),
    }
    with pytest.raises(ValueError, match="NaN"):
        json_source.read_json(spark, str(put(tmp_path, "n.json", '{"a": NaN}')))
    many = json_source.read_json(spark, str(put(tmp_path, "m.json", '[{"a": 1},\n {"a": 2}]')))
    assert many.count() == 2


def test_json_shapes_over_all_records(spark, tmp_path):
    text = (
        '{"n": 1.50, "s": "x -5, \\" 6", "m": {"a": [1]}, "l": [[-2e3], []], "o": {}, "e": []}\n{"n": -0, "m": [true], "l": [[7]], "k": 1, "K": {"t": null}}\n'
        '{"n": 01}\n[1]\n5\n{"n": 2, "n": 3}\n'
    )
    df = json_source.read_json(spark, str(put(tmp_path, "a.jsonl", text)))
    assert df.schema.simpleString() == "struct<K:struct<t:string>,e:array<string>,k_2:string,l:array<array<string>>,m:string,n:string,n_2:string,o:struct<>,s:string>"
    got = sorted((r.n, r.n_2, r.s, r.m, r.l, r.k_2) for r in df.collect())
    assert got == [("-0", None, None, "[true]", [["7"]], "1"), ("1.50", None, 'x -5, " 6', '{"a":["1"]}', [["-2e3"], []], None), ("2", "3", None, None, None, None)]
    with pytest.raises(ValueError, match="no fields"):
        json_source.read_json(spark, str(put(tmp_path, "b.json", "[1, 2]")))


def test_json_leaves_of_lists_in_lists(spark, tmp_path):
    text = '{"a": [[{"b": [1, 2]}, {"b": null}], null, [{"b": [3]}, null]], "c": [[4], null, [[5]]]}\n{"a": null}\n{"a": [{"b": 6}]}\n{"d": [{"e": null}, {"e": [{"f": 7}]}]}\n'
    found = lambda t: sorted((r.name, r.v) for r in json_source.leaf_cells(json_source.read_json(spark, str(put(tmp_path, "a.jsonl", t)))).where("v IS NOT NULL").collect())
    lines = text.splitlines(True)
    assert found(lines[0]) == [("a.b", "1"), ("a.b", "2"), ("a.b", "3"), ("c", "4"), ("c", '["5"]')]
    assert found(lines[3]) == [("d.e.f", "7")]
    assert found(text)[:3] == [("a", '[{"b":["1","2"]},{"b":null}]'), ("a", '[{"b":["3"]},null]'), ("a", '{"b":"6"}')]  # lists and records under one name are text


def test_parquet(spark, tmp_path):
    schema = pa.schema([("id", pa.int64()), ("amt", pa.decimal128(12, 2)), ("big", pa.decimal128(38, 12)), ("f", pa.float32()), ("b", pa.bool_()), ("raw", pa.binary()), ("ts", pa.timestamp("us", "UTC")), ("d", pa.date32()),
                        ("st", pa.struct([("x", pa.int32()), ("y", pa.string())])), ("arr", pa.list_(pa.int32())), ("recs", pa.list_(pa.struct([("k", pa.string())]))), ("m", pa.map_(pa.string(), pa.int32()))])
    path = tmp_path / "t.parquet"
    pq.write_table(pa.Table.from_pylist([{"id": 1}], schema), path)
    out = process(spark, request(path))
    kinds = {c["name"]: (c["type"], c["mode"]) for c in out["columns"]}
    assert kinds["amt"] == ("NUMERIC", "NULLABLE") and kinds["big"] == ("BIGNUMERIC", "NULLABLE") and kinds["id"] == ("INTEGER", "NULLABLE") and kinds["m"] == ("JSON", "NULLABLE")
    assert kinds["arr"] == ("INTEGER", "REPEATED") and kinds["recs"] == ("RECORD", "REPEATED") and kinds["raw"] == ("STRING", "NULLABLE") and kinds["_batch_id"] == ("STRING", "REQUIRED")
    assert [c["name"] for c in next(c for c in out["columns"] if c["name"] == "st")["fields"]] == ["x", "y"]


def test_parquet_footers_of_many_files(spark, tmp_path):
    said = lambda text: {b"description": text.encode()}
    a = pa.schema([pa.field("id", pa.int32(), False, said("the key")), pa.field("at", pa.time64("us")), pa.field("n", pa.int64(), False), pa.field("m", pa.decimal128(5, 2)), pa.field("u", pa.uint64()), pa.field("s", pa.struct([pa.field("x", pa.string(), False)]))])
    b = pa.schema([pa.field("id", pa.int64(), False), pa.field("n", pa.float64(), False, said("number")), pa.field("m", pa.decimal128(9, 1)), pa.field("more", pa.dictionary(pa.int8(), pa.string()), False), pa.field("s", pa.struct([pa.field("x", pa.date32())]))])
    (tmp_path / "t.parquet").mkdir()
    for name, schema, rows in (("a", a, [{"id": i, "n": i} for i in range(7)]), ("b", b, [{"id": i, "n": 0.5, "more": "x"} for i in range(5)])):
        pq.write_table(pa.Table.from_pylist(rows, schema), tmp_path / "t.parquet" / f"{name}.parquet")
    found = declared.parquet_fields(spark, str(tmp_path / "t.parquet"), "e").orderBy("ord").collect()
    got = {r.path: (r.data_type, r.nullable, r.description, r.precision, r.scale) for r in found}
    assert got == {
        "id": ("INTEGER", False, "the key", None, None), "at": ("STRING", True, None, None, None), "n": ("FLOAT", False, "number", None, None), "m": ("DECIMAL", True, None, 10, 2), "u": ("INTEGER", True, None, None, None),
        "s": ("RECORD", True, None, None, None), "s.x": ("STRING", True, None, None, None), "more": ("STRING", True, None, None, None),
    }
    assert {r.row_count for r in found} == {12}
    spark.range(3).selectExpr("id", "named_struct('v', parse_json('1')) as r").withMetadata("id", {"comment": "made by Spark"}).write.parquet(f"file://{tmp_path}/s.parquet")
    own = {r.path: (r.data_type, r.description, r.row_count) for r in declared.parquet_fields(spark, f"file://{tmp_path}/s.parquet", "e").collect()}
    assert own == {"id": ("INTEGER", "made by Spark", 3), "r": ("RECORD", None, 3), "r.v": ("JSON", None, 3)}
    with pytest.raises(Exception, match="some files only"):
        pq.write_table(pa.table({"s": [1]}), tmp_path / "t.parquet" / "c.parquet")
        declared.parquet_fields(spark, str(tmp_path / "t.parquet"), "e")


AVRO = {"type": "record", "name": "R", "doc": "Order events from the shop", "fields": [
    {"name": "id", "type": "long"}, {"name": "opt", "type": ["null", "string"], "doc": "note"}, {"name": "num", "type": ["null", "int", "double"]},
    {"name": "amt", "type": {"type": "bytes", "logicalType": "decimal", "precision": 10, "scale": 2}}, {"name": "ts", "type": {"type": "long", "logicalType": "timestamp-micros"}}, {"name": "d", "type": {"type": "int", "logicalType": "date"}},
    {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "sub", "type": {"type": "record", "name": "S", "fields": [{"name": "x", "type": "int"}]}}]}


def avro_file(spark, path, schema, rows=(), codec=None):
    jvm = spark._jvm
    parsed = jvm.org.apache.avro.Schema.Parser().parse(json.dumps(schema))
    writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(parsed))
    if codec:
        writer.setCodec(jvm.org.apache.avro.file.CodecFactory.fromString(codec))
    writer.create(parsed, jvm.java.io.File(str(path)))
    for n, row in enumerate(rows):
        record = jvm.org.apache.avro.generic.GenericData.Record(parsed)
        for k, v in row.items():
            record.put(k, v)
        writer.append(record)
        if n % 400 == 399:
            writer.sync()  # ends the block
    writer.close()
    return str(path)


def test_avro(spark, tmp_path):
    found, said = declared.avro_fields(spark, avro_file(spark, tmp_path / "a.avro", AVRO), "e")
    got = {r.path: (r.data_type, r.is_array, r.description, r.precision) for r in found.collect()}
    assert said == AVRO["doc"] and got["opt"] == ("STRING", False, "note", None) and got["num"][0] == "FLOAT" and got["amt"] == ("DECIMAL", False, None, 10) and got["ts"][0] == "TIMESTAMP"
    assert got["d"][0] == "DATE" and got["tags"] == ("STRING", True, None, None) and got["m"][0] == "JSON" and got["sub"][0] == "RECORD" and got["sub.x"][0] == "INTEGER"
    mixed = AVRO | {"fields": [{"name": "u", "type": ["string", "int"]}]}
    with pytest.raises(Exception, match="union"):
        declared.avro_fields(spark, avro_file(spark, tmp_path / "u.avro", mixed), "e")


def test_avro_over_many_files(spark, tmp_path):
    (tmp_path / "m.avro").mkdir()
    fields = lambda *f: {"type": "record", "name": "R", "fields": [{"name": n, "type": k} for n, k in f]}
    avro_file(spark, tmp_path / "m.avro" / "a.avro", fields(("id", "int"), ("v", ["null", "int"])), [{"id": i} for i in range(1203)], "deflate")
    avro_file(spark, tmp_path / "m.avro" / "b.avro", fields(("id", "int"), ("v", "double"), ("w", "string")) | {"doc": " second "}, [{"id": i, "v": 0.5, "w": "x" * 100} for i in range(801)], "snappy")
    found, said = declared.avro_fields(spark, str(tmp_path / "m.avro"), "e")
    got = {r.path: (r.data_type, r.nullable, r.row_count) for r in found.collect()}
    assert said == "second" and got == {"id": ("INTEGER", False, 2004), "v": ("FLOAT", True, 2004), "w": ("STRING", True, 2004)}
    whole = (tmp_path / "m.avro" / "a.avro").read_bytes()
    (tmp_path / "cut.avro").write_bytes(whole[: len(whole) - 40])
    (tmp_path / "no.avro").write_bytes(b"something else")
    for name, message in (("cut", "too early"), ("no", "not an Avro")):
        with pytest.raises(Exception, match=message):
            declared.avro_fields(spark, str(tmp_path / f"{name}.avro"), "e")


def test_detection(spark, tmp_path):
    assert detect_format(spark, str(put(tmp_path, "x.JSONL", "{}"))) == "json"
    for name, text in (("e.csv", ""), ("noext", "a"), ("x.txt", "a")):
        with pytest.raises(ValueError):
            detect_format(spark, str(put(tmp_path, name, text)))
    with pytest.raises(FileNotFoundError):
        detect_format(spark, str(tmp_path / "missing.csv"))


def test_versions_and_artifacts(spark, tmp_path):
    places = {"registry": f"file://{tmp_path}/registry", "audit": f"file://{tmp_path}/audit", "csv": {"header_mode": "PRESENT"}}
    path = put(tmp_path, "v.csv", "id,userEmail\n1,a@b\n2,c@d\n")
    first = process(spark, request(path, **places))
    assert (first["decision"], first["version"], first["security"]["has_pii"]) == ("CREATE", 1, True)
    files = write_artifacts(first, str(tmp_path / "out"))
    assert files == ["create_table.sql", "create_table_spark.sql", "documentation.md", "run_summary.json", "schema.json", "schema.yaml"]
    assert "| userEmail | user_email |" in first["artifacts"]["documentation.md"] and "PARTITION BY DATE(`_ingestion_timestamp`)" in first["artifacts"]["create_table.sql"]
    assert process(spark, request(path, **places))["decision"] == "NO_OP"
    put(tmp_path, "v.csv", "id,userEmail,note\n1,a@b,x\n2,c@d,y\n")
    grown = process(spark, request(path, **places))
    assert (grown["decision"], grown["version"]) == ("NON_BREAKING", 1) and "ADD COLUMN `note` STRING" in grown["artifacts"]["migration.sql"] and "create_table.sql" not in grown["artifacts"]
    put(tmp_path, "v.csv", "id,userEmail\nx,a@b\ny,c@d\n")
    with pytest.raises(governance.DriftRefused):
        process(spark, request(path, policy="STRICT", **places))
    assert process(spark, request(path, policy="WARN", **places))["status"] == "WARNING"
    auto = process(spark, request(path, policy="AUTO", **places))
    assert (auto["decision"], auto["version"]) == ("BREAKING", 2)
    audit = spark.read.parquet(places["audit"])
    assert audit.count() == 6 and audit.where(F.col("status") == "FAILED").count() == 1
    assert process(spark, request(path, preview=True, cluster_override=["id"]))["clustering"][0]["confidence"] == "USER_DEFINED"
    spark.sql("create schema if not exists finance_dev_raw")
    spark.sql(first["artifacts"]["create_table_spark.sql"].rstrip().rstrip(";"))
    assert "user_email" in spark.table("finance_dev_raw.finance_sales_gold").columns
