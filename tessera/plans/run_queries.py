"""Registered queries over whole runs: what requests of each mode lead to, what sources refuse, and the documentation of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cli import request_of
from tessera.plans.process import Request, process
from tessera.plans.queries import table
from tessera.plans.source_queries import ORDER_HEADER, _order_lines, written
from tessera.sources import csv_source
from tessera.sources.shared import shared_path
from tessera.standards import METADATA_COLUMNS, NO_CLUSTERING


def _with_rows(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.crossJoin(F.broadcast(table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("read"))))  # one row


def process_modes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over a CSV of orders: all skipped by a config file, a breaking change under STRICT, a preview with hints, one without a domain; and who was audited."""
    path, registry, audit = written(_order_lines(spark, sf_dir), ORDER_HEADER), shared_path(spark, "registry"), shared_path(spark, "audit")
    config = {
        "entity": "orders", "domain": "sales", "environment": "dev", "zone": "raw", "layer": "gold", "output": "JSON", "source": {"file_path": path, "csv_override": {"header_mode": "PRESENT"}},
        "settings": {"table_description": "Orders of the shop, one row each", "registry": registry, "audit": audit}, "partitioning": {"mode": "SKIP"}, "clustering": {"mode": "SKIP"},
    }
    kept = {"path": path, "entity": "orders", "environment": "dev", "zone": "raw", "layer": "gold", "audit": audit, "csv": {"header_mode": "PRESENT"}}
    asked = {
        "skipped": request_of(config),
        "refused": request_of(config | {"settings": config["settings"] | {"drift_policy": "STRICT", "type_overrides": {"o_custkey": "STRING"}}}),
        "preview": Request(domain="sales", preview=True, query_patterns={"joins": ["o_custkey"], "filters": ["o_orderpriority"]}, **kept),
        "nameless": Request(domain=" ", **kept),
    }
    said = []
    for name, request in asked.items():
        try:
            out = process(spark, request)
        except Exception as e:
            said.append((name, "FAILED", None, None, None, None, None, None, str(e)))
            continue
        by = out["partitioning"]
        said.append((name, out["status"], out.get("decision"), out.get("version"), ",".join(sorted(out.get("artifacts", {}))), by["column"] if by["strategy"] else by["confidence"],
                     ",".join(c["column"] for c in out["clustering"]), out["clustering_reason"], None))
    runs = spark.createDataFrame(said, "run string, status string, decision string, version int, artifacts string, partitioning string, clustering string, reason string, error string")
    kept_rows = spark.read.parquet(audit).select("status", "error", F.col("user_id").alias("audited"))
    return _with_rows(runs.join(kept_rows, (runs.status == kept_rows.status) & runs.error.eqNullSafe(kept_rows.error), "left").select(runs["*"], "audited"), spark, sf_dir)


PROCESS_MODES_SQL = f"""WITH c AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k1, count(DISTINCT o_custkey) AS k2, count(DISTINCT o_orderpriority) AS k3, count(DISTINCT o_orderstatus) AS k4 FROM orders),
r AS (SELECT 0 AS ord, 'o_orderkey' AS name, k1 / n AS ratio, 1 AS more FROM c UNION ALL SELECT 1, 'o_custkey', k2 / n, 1 + 3 FROM c UNION ALL SELECT 4, 'o_orderpriority', k3 / n, 2 FROM c UNION ALL SELECT 5, 'o_orderstatus', k4 / n, -1 FROM c),
s AS (SELECT ord, name, more + CASE WHEN round(ratio, 4) > 0.7 THEN 4 WHEN round(ratio, 4) < 0.05 THEN -3 ELSE 0 END AS score FROM r),
best AS (SELECT coalesce(string_agg(name, ',' ORDER BY score DESC, ord), '') AS clustering FROM s WHERE score > 0)
SELECT run, status, decision, CAST(version AS INTEGER) AS version, artifacts, partitioning, CASE run WHEN 'preview' THEN (SELECT clustering FROM best) ELSE clustering END AS clustering, reason, error, audited, (SELECT count(*) FROM orders) AS read
FROM (VALUES ('skipped', 'SUCCESS', 'CREATE', 1, 'schema.json', 'SKIPPED', '', '{NO_CLUSTERING["skipped"]}', NULL, 'config_executor'),
  ('refused', 'FAILED', NULL, NULL, NULL, NULL, NULL, NULL, 'orders: breaking change: TYPE_CHANGE o_custkey', 'config_executor'), ('preview', 'PREVIEW', NULL, NULL, '', 'o_orderdate', '', NULL, NULL, NULL),
  ('nameless', 'FAILED', NULL, NULL, NULL, NULL, NULL, NULL, 'domain is required', 'anonymous')) AS v(run, status, decision, version, artifacts, partitioning, clustering, reason, error, audited)"""


def csv_refusals_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of CSV files of orders that cannot be read: mixed delimiters, an open quote in one line, no header, no delimiter to split at; a header said to be absent is found."""
    lines = _order_lines(spark, sf_dir)
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    opened = lines.withColumn("line", F.when(F.col("line").startswith(f"{last},"), F.concat(F.lit('"'), "line")).otherwise(F.col("line")))
    cases = {
        "mixed": (lines, ORDER_HEADER.replace("o_totalprice,", "o_totalprice;"), {"mode": "SPLIT", "delimiter": ","}), "open": (opened, ORDER_HEADER, {"header_mode": "PRESENT"}),
        "absent": (lines, ORDER_HEADER, {"header_mode": "ABSENT"}), "data": (lines, "1,2,3.5,2020-01-01,4,5", {"header_mode": "ABSENT"}), "mode": (lines, ORDER_HEADER, {"header_mode": "MAYBE"}),
        "split": (lines, ORDER_HEADER, {"mode": "SPLIT"}), "none": (lines.where("false"), "", {}),
    }
    said = []
    for name, (made, header, asked) in cases.items():
        path = written(made, header) if header else shared_path(spark, "csv") + ".csv"
        if not header:
            made.write.text(path)
        try:
            said.append((name, str(csv_source.read_csv(spark, path, "orders", **asked).rows.count())))
        except ValueError as e:
            said.append((name, str(e).removeprefix(path).strip()))
    return _with_rows(spark.createDataFrame(said, "name string, said string"), spark, sf_dir)


CSV_REFUSALS_SQL = """WITH l AS (SELECT arg_max(concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, o_orderstatus), o_orderkey) AS line FROM orders)
SELECT name, CASE name WHEN 'open' THEN 'unbalanced quotes: "' || (SELECT line FROM l) WHEN 'absent' THEN CAST((SELECT count(*) FROM orders) AS VARCHAR) ELSE said END AS said, (SELECT count(*) FROM orders) AS read
FROM (VALUES ('mixed', 'header mixes \'\',\'\' with [\'\';\'\']'), ('open', NULL), ('absent', NULL), ('data', 'no header line was found'), ('mode', 'unknown header mode MAYBE'), ('split', 'SPLIT needs a delimiter'), ('none', 'has no lines')) AS v(name, said)"""


def documentation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documentation that a run makes of a CSV of orders, in all its sections but the time it was made."""
    header = ORDER_HEADER.replace("o_orderpriority", "customerEmail").replace("o_totalprice", "Salary Paid")
    request = Request(written(_order_lines(spark, sf_dir), header), "orders", "sales", "dev", "raw", "gold", "Orders of the shop, one row each", output_type="DOCUMENTATION", csv={"header_mode": "PRESENT"},
                      partition_override={"column": "o_orderdate", "column_type": "DATE"}, cluster_override=["o_custkey", "o_orderkey"])
    text = process(spark, request)["artifacts"]["documentation.md"]
    lines = [line for line in text.splitlines() if line and "Generated At" not in line]
    return _with_rows(spark.createDataFrame(list(enumerate(lines)), "place int, line string"), spark, sf_dir)


def _documentation_sql() -> str:
    own = (("o_orderkey", "integer"), ("o_custkey", "integer"), ("salary_paid", "decimal"), ("o_orderdate", "date"), ("customer_email", "string"), ("o_orderstatus", "string"))
    cells = [f"| {n} | {'NUMERIC' if k == 'decimal' else k.upper()} | NULLABLE | {n.replace('_', ' ').capitalize()} stored as {k} value. Nullable field. |" for n, k in own]
    system = [f"| {n} | {k} | {m} | {d} |" for n, k, m, d in METADATA_COLUMNS]
    heads = "| Column Name | Data Type | Mode | Description |", "|---|---|---|---|"
    named = ("| o_orderkey | UNKNOWN | UNKNOWN | MEDIUM | REVIEW_REQUIRED |", "| o_custkey | UNKNOWN | UNKNOWN | MEDIUM | REVIEW_REQUIRED |", "| salary_paid | SENSITIVE.FINANCIAL | SENSITIVE | MEDIUM | RESTRICTED_ACCESS |", "| customer_email | PII.EMAIL | PII | HIGH | RESTRICTED_ACCESS |")
    lines = [
        "# sales_orders_gold", "## Overview", "Orders of the shop, one row each", "---", "## Table Properties", "- **Domain**: sales", "- **Environment**: dev", "- **Zone**: raw", "- **Layer**: gold", "- **Partitioning**: DAY(o_orderdate)", "- **Clustering**: o_custkey, o_orderkey",
        "---", "## Versioning Information", "- **Entity**: orders", "- **Version**: v1", "- **Decision**: CREATE", "- **Drift Policy Applied**: WARN",
        "---", "## Security & Governance", "### Classification Summary", f"- **Total Columns**: {len(own) + len(METADATA_COLUMNS)}", f"- **Classified Columns**: {len(named)}", "### Classified Columns", "| Column | Classification | Category | Confidence | Recommended Control |", "|---|---|---|---|---|", *named,
        "---", "## Business Columns", *heads, *cells, "---", "## System / Metadata Columns", *heads, *system,
        "---", "## Naming Normalization", "| Original Column | Standardized Column |", "|---|---|", "| Salary Paid | salary_paid |", "| customerEmail | customer_email |", "---", "## Metadata",
    ]
    values = ", ".join(f"({i}, '{line}')" for i, line in enumerate(lines))
    return f"SELECT CAST(place AS INTEGER) AS place, line, (SELECT count(*) FROM orders) AS read FROM (VALUES {values}) AS v(place, line)"


QUERIES = {"process_modes_orders": process_modes_orders, "csv_refusals_orders": csv_refusals_orders, "documentation_orders": documentation_orders}
ORACLES = {"process_modes_orders": PROCESS_MODES_SQL, "csv_refusals_orders": CSV_REFUSALS_SQL, "documentation_orders": _documentation_sql()}
