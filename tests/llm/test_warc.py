import gzip

import duckdb
import pytest

from tessera.llm import warc
from tessera.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [
    (4, "http://a.b/ c", "<p>é same</p>"), (2, "http://x/\n1", "<p>é same</p>"), (3, None, None), (7, "u", ""), (9, "http://é/", "HTTP/1.0 200 OK\r\n\r\nWARC/1.1\r\n\r\n\n\n"),
    (1, "-", "x" * 300_000), (None, "http://n/", "<p>é same</p>"), (5, "http://q/", "tail\r\n\r\n"), (6, "http://q/", "tail\r\n\r\n"),
]


def write(spark, rows, version=2, min_bytes=0):
    arc, out = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), arc, version)
    warc.convert_arc(spark, arc, out, min_bytes)
    return warc.read_archives(spark, out)


def test_round_trip_matches_sql(spark):
    got = write(spark, ROWS)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", ROWS)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"select {', '.join(cols)} from ({warc.ORACLE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))
    bodies = {r.page_id: bytes(r.payload) for r in got.collect() if r.record_type == "response"}
    assert bodies == {i: (h or "").encode() for i, _, h in ROWS if i in bodies} and set(bodies) == {2, 3, 9, 1, 5}


def test_small_payloads_stay_responses(spark):
    got = {r.page_id: (r.record_type, r.refers_to) for r in write(spark, ROWS, min_bytes=14).collect()}
    assert got[4] == ("revisit", 2) and got[7] == got[6] == ("response", None)


def test_repeated_rows_and_empty_table(spark):
    got = write(spark, [(1, "u", "same"), (1, "u", "same"), (2, "u", "same")]).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]
    assert len({r.record_id for r in got}) == 3
    assert write(spark, []).collect() == []


def test_header_lines_of_both_versions():
    blocks = [warc.HTTP % 4 + b"body", b"GIF89a \n\n", b""]
    for version in (1, 2):
        raw = warc.description(version, "x.arc") + b"".join(warc.arc_record("http://a/b c", "page:7", b, version, "x.arc") + b"\n" for b in blocks)
        for data in (raw, gzip.compress(raw), gzip.compress(raw[:200]) + gzip.compress(raw[200:])):
            got = list(warc.read_arc(data))
            assert [b for _, b in got] == blocks and {f["url"] for f, _ in got} == {"http://a/b c"}
        made = [warc.synthesised(f, b) for f, b in got]
        assert [m["kind"] for m in made] == ["response", "resource", "resource"] and made[0]["n"] == 4
        assert made[0]["date"] == "1996-01-01T00:00:00Z" and made[0]["place"] == ("page:7" if version == 2 else "-")


def test_cut_off_files_are_errors():
    raw = warc.description(1, "x") + warc.arc_record("u", "", b"12345", 1, "x")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_arc(raw[:-1]))
    with pytest.raises(ValueError, match="header line"):
        list(warc.read_arc(raw + b"\nnot a record\n"))


def test_bytes_that_are_not_utf8_survive(spark):
    arc = spark.createDataFrame([(warc.description(1, "x")[:-1] + b"\n" + warc.arc_record("u", "", b"\xff\xfe\x00", 1, "x"),)], "value binary")
    path, out = new_path(spark, "arc"), new_path(spark, "warc")
    arc.selectExpr("cast(value as string)").write.text(path)
    warc.convert_arc(spark, path, out)
    assert [bytes(r.payload) for r in warc.read_archives(spark, out).collect()] == [b"\xff\xfe\x00"]
