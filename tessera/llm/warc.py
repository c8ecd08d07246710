"""Legacy archive converter: ARC files of versions 1 and 2 to WARC, and a WARC reader.

An ARC file begins with a ``filedesc:`` record whose body names the version, and so which fields
header lines have; each record is a header line, then as many bytes as its last field declares,
then a line feed. Fields are taken from the right, so a url may hold spaces. Conversion makes up
what WARC asks for and ARC lacks: a record id (a name-based UUID of the record's place and
content), an ISO date, a type (``response`` for an HTTP message, else ``resource``), and SHA-1
digests of block and payload. Of records with equal payloads of at least ``min_bytes`` the one with
the smallest key stays a response and the others become revisits of it without a body.

Files are written by Spark's text writer, whose line separator is the one that ends a record, and
read with the ``binaryFile`` source; a task holds one file and streams its records. The size of
files follows the partitions that are written.

Defined results: null html is an empty payload; a null url is written as ``-``; a null page_id gets
a record of its own, read back as null; repeated rows are records of their own, of which one is
the response; an empty table gives an empty archive; what is cut off or has no valid header line ends
the reading of its file with an error that names the place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, stage, table

# The header fields of each ARC version, and the description record's two lines.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "19960101000000"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
BATCH = 8 << 20  # payload bytes in a batch of records
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:arc")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def description(version: int, name: str) -> bytes:
    body = f"{version} 0 tessera\n{TITLES[version]}\n\n".encode()
    extra = " 200 - - 0 %s" % name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(url: str, location: str, block: bytes, version: int, name: str) -> bytes:
    clean = " ".join((url or "-").split()) or "-"
    middle = f" 200 - {location} 0 {name}" if version == 2 else ""
    return f"{clean} 0.0.0.0 {DATE} text/html{middle} {len(block)}\n".encode() + block


class Reader:
    """Bytes of a plain or gzip file of any number of members, a piece at a time."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.done = raw, 0, bytearray(), 0
        self.gzip = raw[:2] == b"\x1f\x8b"
        self.machine = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + (1 << 20)]
        self.at += len(piece)
        if not self.gzip:
            self.held += piece
            return True
        while piece:
            self.held += self.machine.decompress(piece)
            piece = self.machine.unused_data
            if self.machine.eof:
                self.machine = zlib.decompressobj(31)
        return True

    def _drop(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.done += n
        return out

    def line(self) -> bytes | None:
        """The next line with its end; None after the last."""
        start = 0
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held)
            if not self._more():
                return self._drop(len(self.held)) if self.held else None
        return self._drop(end + 1)

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"cut off at byte {self.done}: {n} bytes declared, {len(self.held)} there")
        return self._drop(n)


def read_arc(raw: bytes):
    """(fields, block) of each record of an ARC file but its description."""
    reader, version, name = Reader(raw), None, ""
    while True:
        start = reader.done
        line = reader.line()
        if line is None:
            return
        if not line.strip():
            continue
        words = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if line.startswith(b"filedesc:"):
            body = reader.exactly(int(words[-1]))
            version, name = int(body.split(b" ", 1)[0]), words[0]
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} at byte {start}")
            continue
        names = FIELDS.get(version)
        if names is None or len(words) < len(names) or not words[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {start}: {line[:80]!r}")
        tail = words[len(words) - len(names) + 1 :]
        fields = dict(zip(names, [" ".join(words[: len(words) - len(names) + 1]), *tail], strict=True))
        yield fields | {"at": f"{name}#{start}"}, reader.exactly(int(words[-1]))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload; an empty head where the block is not an HTTP message."""
    if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[: end + 4], block[end + 4 :]
    return b"", block


def synthesised(fields: dict, block: bytes) -> dict:
    """The WARC fields of an ARC record."""
    head, payload = split_http(block)
    digest = base32_sha1(payload)
    place = fields.get("location", "-")
    name = "|".join((fields["at"], fields["url"], fields["date"], base32_sha1(block)))
    when = datetime.strptime((fields["date"] + "0" * 14)[:14], "%Y%m%d%H%M%S")
    return {
        "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", "kind": "response" if head else "resource", "url": fields["url"],
        "date": when.strftime("%Y-%m-%dT%H:%M:%SZ"), "place": place, "digest": digest, "n": len(payload), "block": block,
        "content_type": "application/http; msgtype=response" if head else fields["content_type"],
    }


def warc_record(r: dict, refers_to: str | None, refers_place: str | None) -> bytes:
    """A record up to its last two line ends, which the writer adds."""
    block = split_http(r["block"])[0] if refers_to else r["block"]
    lines = [
        ("WARC-Type", "revisit" if refers_to else r["kind"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]),
        ("WARC-Payload-Digest", "sha1:" + r["digest"]), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("X-Payload-Length", r["n"]), ("X-Source-Location", r["place"]),
    ]
    if refers_to:
        lines += [("WARC-Refers-To", refers_to), ("X-Refers-To-Location", refers_place), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", r["content_type"]), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block


def read_warc(raw: bytes):
    """(headers in lower case, block) of each record of a WARC file."""
    reader = Reader(raw)
    while True:
        start = reader.done
        line = reader.line()
        if line is None:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {start}: {line[:80]!r}")
        headers = {}
        while (line := reader.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, reader.exactly(int(headers["content-length"]))


def write_arc(rows: DataFrame, path: str, version: int = 2, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """An ARC file for each partition; the key is kept as the location of version 2."""

    def run(batches):
        name, first = f"part-{uuid.uuid4().hex}.arc", True
        for batch in batches:
            out = [description(version, name)[:-1]] if first else []  # the writer adds the last line feed
            first = False
            for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (h or "").encode("utf-8", "surrogatepass")
                out.append(arc_record(u, f"page:{'-' if k is None else k}", HTTP % len(body) + body, version, name))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.select(key, url, html).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _records(spark: SparkSession, path: str, blocks: bool) -> DataFrame:
    """Synthesised WARC fields of the records of ARC files, with or without their blocks."""
    names = ["record_id", "kind", "url", "date", "place", "digest", "n", "content_type"] + ["block"] * blocks
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string()] + [pa.binary()] * blocks

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], k) for x, k in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for fields, block in read_arc(raw.as_py()):
                    rows.append(synthesised(fields, block))
                    held += len(block) if blocks else 500
                    if held >= BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "record_id string, kind string, url string, date string, place string, digest string, n long, content_type string" + ", block binary" * blocks
    return _files(spark, path).mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def _number(place: str) -> F.Column:
    return F.expr(f"try_cast(substring({place}, 6) AS bigint)")


def convert_arc(spark: SparkSession, arc: str, path: str, min_bytes: int = 0) -> None:
    """WARC files of all records of the ARC files under ``arc``, with revisits of equal payloads."""
    known = stage(_records(spark, arc, False).select("record_id", "place", "digest", "n").withColumn("k", _number("place")), "warc-known")
    order = F.struct(F.col("k").isNull().alias("x"), "k", "record_id", "place")
    heads = known.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    heads = stage(heads.select("digest", F.col("head.record_id").alias("head_id"), F.col("head.place").alias("head_place")), "warc-heads")
    again = known.where(F.col("n") >= min_bytes).join(heads, "digest").where("record_id != head_id")
    again = stage(again.groupBy("record_id").agg(F.first("head_id").alias("head_id"), F.first("head_place").alias("head_place")), "warc-again")
    rows = _records(spark, arc, True).join(again, "record_id", "left")

    def run(batches):
        for batch in batches:
            out = [warc_record(r, r["head_id"], r["head_place"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_id, record_type, url, date, payload, payload_bytes, payload_digest, refers_to)`` of WARC files.

    The digest of a record with a body is that of its payload as read; where the header states
    another, the read fails. A revisit's are those it states, its payload is null.
    """
    names = ["place", "record_id", "record_type", "url", "date", "payload", "payload_bytes", "payload_digest", "refers"]
    kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def row(h, block):
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        if h["warc-type"] == "revisit":
            body, n, digest = None, int(h["x-payload-length"]), stated
        else:
            body = split_http(block)[1]
            n, digest = len(body), base32_sha1(body)
            if stated and stated != digest:
                raise ValueError(f"{h['warc-record-id']}: payload digest {digest}, stated {stated}")
        return (h.get("x-source-location"), h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h["warc-date"], body, n, digest, h.get("x-refers-to-location"))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for headers, block in read_warc(raw.as_py()):
                    rows.append(row(headers, block))
                    held += len(block)
                    if held >= BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "place string, record_id string, record_type string, url string, date string, payload binary, payload_bytes long, payload_digest string, refers string"
    return _files(spark, path).mapInArrow(run, schema).select(
        _number("place").alias("page_id"), "record_id", "record_type", "url", "date", "payload", "payload_bytes", "payload_digest", _number("refers").alias("refers_to")
    )


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert_arc(spark, arc, warc)
    return read_archives(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, row_number() OVER () AS row FROM pages),
f AS (SELECT *, first_value(row) OVER w AS head, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY hex, body ORDER BY page_id NULLS LAST, row))
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN row = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN row != head THEN first END AS refers_to
FROM f
"""
