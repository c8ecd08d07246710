"""CSV as lines: cleaning, sniffing, checks of width and quotes, and rows of text.

Only the first lines come to the driver, to find delimiter and header; all else is expressions
over the distributed lines, in two passes: one checks, one reads. ``sample`` limits reading to the first lines, as a quick look does.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.operators.fields import inferred_fields
from tessera.operators.profile import once
from tessera.sources.shared import kept
from tessera.standards import OVERRIDE_TYPES

DELIMITERS, FALLBACK = ",;\t|", ";,\t|"
HEAD = 20


@dataclass
class CsvTable:
    names: list[str]
    rows: DataFrame
    mismatches: DataFrame
    delimiter: str | None
    warning: str | None = None
    uneven: int = 0  # lines that are not as wide as the header


def clean_lines(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """``(line, file, start)`` without byte order mark, blank lines and lines that start with # or --; start is that of the block of its file."""
    value = F.col("value")
    lines = once(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")), line=F.when(value.startswith("\ufeff"), F.substring(value, 2, 1 << 30)).otherwise(value))
    lines = keep_lines(lines.select("line", "file", "start"), "line")
    return lines.limit(sample) if sample else lines


def keep_lines(lines: DataFrame, line: str) -> DataFrame:
    text = F.col("__text")
    return once(lines, __text=P.strip(F.col(line))).where((text != "") & ~text.startswith("#") & ~text.startswith("--")).drop("__text")


def sniff(head: list[str]) -> str:
    """The delimiter of the first lines; where the sniffer is unsure, the first of ``; , tab |`` in the first line."""
    try:
        return csv.Sniffer().sniff("\n".join(head[:HEAD]), delimiters=DELIMITERS).delimiter
    except csv.Error:
        return next((d for d in FALLBACK if head and d in head[0]), ",")


def looks_like_header(cells: list[str]) -> bool:
    named = [c for c in (x.strip() for x in cells) if re.match(r"^[A-Za-z_][\w .-]*$", c)]
    return bool(cells) and len(named) / len(cells) >= 0.6


def has_header(head: list[str], delimiter: str | None, mode: str = "AUTO") -> bool:
    first = next(csv.reader(head[:1], delimiter=delimiter)) if delimiter else head[:1]
    if mode == "PRESENT":
        return True
    if mode not in ("AUTO", "ABSENT"):
        raise ValueError(f"unknown header mode {mode}")
    if mode == "ABSENT":
        return looks_like_header(first)
    try:
        found = csv.Sniffer().has_header("\n".join(head[:HEAD]))
    except csv.Error:
        found = True
    return found or looks_like_header(first)


def unbalanced_quotes(line: Column) -> Column:
    """Whether a line has an odd number of quotes, doubled ones aside."""
    return line.contains('"') & (F.length(F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), '[^"]', "")) % 2 == 1)


def width(line: Column, delimiter: str) -> Column:
    """The number of cells: delimiters outside quotes, and one."""
    bare = F.when(line.contains('"'), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)
    return (1 + (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter)).cast("int")


def cells_of(line: Column, delimiter: str) -> Column:
    """The cells of a line as an array of text, without the quotes around them; in one pass over the line."""
    sep = re.escape(delimiter)
    plain = rf'[^"{sep}]++' if len(delimiter) == 1 else rf'(?!{sep})[^"]'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{sep}((?:{plain}|"[^"]*+")*+)'), 1)
    return F.transform(found, lambda c: F.when(c.rlike(r'(?s)^\s*".*"\s*$'), F.replace(F.regexp_replace(c, r'(?s)^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def with_place(lines: DataFrame) -> DataFrame:
    """``lines`` with ``place``, which grows along a file: the partition's number, then the line's within it."""
    return lines.withColumn("place", F.monotonically_increasing_id())


def checked(placed: DataFrame, delimiter: str | None, header: str, names: int) -> DataFrame:
    """A row for each block of a file: how many lines, the places of the first, of the first like ``header`` and of the first with odd quotes, and how many are not ``names`` cells wide.

    One pass over the lines does all checks, in fixed-width numbers, so that no line is sorted; its few rows are kept in the shared folder for numbers and headers.
    """
    line, place = F.col("line"), F.col("place")
    wrong = (width(line, delimiter) != names) if delimiter else F.lit(False)
    rows = placed.groupBy("file", "start", F.shiftright("place", 33).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.min(F.when(line == header, place)).alias("header"), F.min(F.when(unbalanced_quotes(line), place)).alias("odd"), F.count_if(wrong).alias("uneven"),
    )
    return kept(rows, "csv-checks")


def _small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def without_headers(placed: DataFrame, checks: DataFrame) -> DataFrame:
    """``placed`` without the first line of each file, where that is the header; other lines like it are data."""
    tops = checks.groupBy("file").agg(F.min(F.struct("start", "first", "header")).alias("top")).where("top.first = top.header").select("file", F.col("top.first").alias("place"))
    return placed.join(_small(tops), ["file", "place"], "left_anti")


def numbered(placed: DataFrame, checks: DataFrame) -> DataFrame:
    """``placed`` with ``row_number`` from 1 over all lines: places within partitions, and how many lines are in those before."""
    counts = checks.groupBy("part").agg(F.sum("n").alias("n"))
    before = counts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    joined = placed.withColumn("part", F.shiftright("place", 33)).join(_small(before), "part")  # one row a partition
    return joined.withColumn("row_number", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before")


def mixed_delimiters(header: str, delimiter: str) -> list[str]:
    return [d for d in DELIMITERS if d != delimiter and d in re.sub(r'"[^"]*"', "", header)]


def repaired(names: list[str], entity: str) -> list[str]:
    """Blank names become ``{entity}_{position}``."""
    return [n.strip() or f"{entity}_{i}" for i, n in enumerate(names, 1)]


def read_csv(spark: SparkSession, path: str, entity: str, mode: str = "AUTO", delimiter: str | None = None, header_mode: str = "AUTO",
             remove_quotes: bool = False, sample: int | None = None) -> CsvTable:
    """Rows of text of a CSV file. ``mode``: AUTO, SPLIT (with ``delimiter``) or SINGLE (a line is one cell)."""
    lines = clean_lines(spark, path, sample)
    if remove_quotes:
        wrapped = F.regexp_extract("line", '^\\s*"(.*)"\\s*$', 1)
        lines = lines.withColumn("line", F.when(F.col("line").rlike('^\\s*".*"\\s*$'), F.replace(wrapped, F.lit('""'), F.lit('"'))).otherwise(F.trim("line")))
    head = [r.line for r in lines.take(HEAD)]
    if not head:
        raise ValueError(f"{path} has no lines")
    if mode == "SPLIT" and not delimiter:
        raise ValueError("SPLIT needs a delimiter")
    sep = None if mode == "SINGLE" else delimiter.replace("\\t", "\t") if mode == "SPLIT" else sniff(head)
    if not has_header(head, sep, header_mode):
        raise ValueError("no header line was found")
    if sep and (mixed := mixed_delimiters(head[0], sep)):
        raise ValueError(f"header mixes {sep!r} with {mixed}")
    names = repaired(next(csv.reader([head[0]], delimiter=sep)) if sep else head[:1], entity)
    unique = [f"{n}#{i}" if names.index(n) != i else n for i, n in enumerate(names)]
    warning = "POTENTIAL_MALFORMED_HEADER" if len(names) == 1 and re.search(r"[,;\t| ]", names[0]) else None
    placed = with_place(lines)
    checks = checked(placed, sep, head[0], len(names))
    found = checks.agg(F.min("odd").alias("odd"), F.sum("uneven").alias("uneven")).first()
    if found.odd is not None:
        raise ValueError(f"unbalanced quotes: {placed.where(F.col('place') == found.odd).first().line[:200]}")
    body = without_headers(placed, checks)
    if sep is None:
        return CsvTable(unique, body.select(F.col("line").alias(unique[0])), body.limit(0), None, warning)
    rows = body.select(F.from_csv("line", ", ".join(f"`{n}` STRING" for n in unique), {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    odd_width = width(F.col("line"), sep) != len(names)
    parts = cells_of(F.col("line"), sep)
    wrong = numbered(placed, checks).where(odd_width & (F.col("row_number") > 1)).select(
        "row_number", "line", F.lit(len(names)).alias("expected"), F.size(parts).alias("actual"),
        F.slice(F.array(*map(F.lit, names)), F.size(parts) + 1, F.lit(len(names))).alias("missing_columns"),
        F.slice(parts, len(names) + 1, F.greatest(F.size(parts), F.lit(1))).alias("extra_values"),
        F.map_from_arrays(F.array(*map(F.lit, unique)), F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.coalesce(F.try_element_at(parts, i), F.lit("<MISSING>")))).alias("mapped_preview"),
    )
    return CsvTable(unique, rows, wrong, sep, warning, found.uneven)


def csv_fields(table: CsvTable, entity: str, confirmed: bool = False, overrides: dict[str, str] | None = None) -> DataFrame:
    """Inferred fields, of one pass over the table; a confirmed malformed one has the columns that its first bad row lacks as STRING."""
    for name, kind in (overrides or {}).items():
        if kind.upper() not in OVERRIDE_TYPES:
            raise ValueError(f"{name}: {kind} cannot be set")
    fields = kept(inferred_fields(entity, table.rows), "csv-fields")
    bad = table.mismatches.orderBy("row_number").first() if confirmed and table.uneven else None
    if bad and bad.missing_columns:
        missing = F.col("name").isin(*bad.missing_columns)
        fields = fields.withColumns({"data_type": F.when(missing, "STRING").otherwise(F.col("data_type")), "nullable": F.col("nullable") & ~missing})
    for name, kind in (overrides or {}).items():
        from tessera.functions.names import normalized

        hit = (F.col("name") == name) | (normalized(F.col("name")) == normalized(F.lit(name)))
        fields = fields.withColumn("data_type", F.when(hit, kind.upper()).otherwise(F.col("data_type")))
    naive = fields.where("data_type = 'NAIVE_TIMESTAMP'").select("name").collect()
    if naive:
        raise ValueError("timestamps without zone in " + ", ".join(r.name for r in naive))
    return fields
