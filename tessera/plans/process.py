"""One run: a file to a governed schema and its artifacts."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import advice, fields, governance
from tessera.operators.nesting import PATH_SCHEMA, path_rows
from tessera.operators.registry import Registry
from tessera.plans import render, render_rows
from tessera.sources import csv_source, declared, json_source
from tessera.sources.detect import detect_format
from tessera.sources.shared import kept
from tessera.standards import AVRO_PARTITION_NOTE, DECLARED_CLUSTER_NOTE, METADATA_NAMES, NO_CLUSTERING

LOG = logging.getLogger("tessera")
ARTIFACTS = ("schema.json", "schema.yaml", "migration.sql", "create_table.sql", "create_table_spark.sql", "documentation.md", "run_summary.json")
OUTPUTS = ("JSON", "YAML", "DDL", "DOCUMENTATION", "ALL_FORMATS")
AUDIT_SCHEMA = "request_id string, at timestamp, user_id string, entity string, path string, format string, policy string, decision string, status string, version int, seconds double, error string"


@dataclass
class Request:
    """What a run is asked for. ``partition_override``: SKIP, or a dict of a manual choice."""

    path: str
    entity: str
    domain: str
    environment: str
    zone: str
    layer: str
    table_description: str | None = None
    policy: str = "WARN"
    output_type: str = "ALL_FORMATS"
    registry: str | None = None
    audit: str | None = None
    user_id: str = "anonymous"
    preview: bool = False
    sample: int | None = None
    csv: dict = field(default_factory=dict)
    type_overrides: dict = field(default_factory=dict)
    confirm_malformed: bool = False
    partition_override: dict | str | None = None
    cluster_override: list | None = None
    query_patterns: dict | None = None
    apply_partitioning: bool = True
    apply_clustering: bool = True
    exclude_metadata: bool = False

    def check(self) -> None:
        for name in ("path", "entity", "domain", "environment", "zone", "layer"):
            if not str(getattr(self, name) or "").strip():
                raise ValueError(f"{name} is required")
        if self.policy not in ("STRICT", "WARN", "AUTO"):
            raise ValueError(f"unknown policy {self.policy}")
        if self.output_type not in OUTPUTS:
            raise ValueError(f"unknown output type {self.output_type}")


def read_fields(spark: SparkSession, request: Request) -> tuple[str, DataFrame, str | None, list]:
    """Format, fields, description and examples of malformed rows."""
    kind = detect_format(spark, request.path)
    if kind == "csv":
        table = csv_source.read_csv(spark, request.path, request.entity, sample=request.sample, **request.csv)
        bad = [] if request.confirm_malformed or not table.uneven else [r.asDict() for r in table.mismatches.orderBy("row_number").limit(1).collect()]
        if bad:
            return kind, None, None, bad
        return kind, csv_source.csv_fields(table, request.entity, request.confirm_malformed, request.type_overrides), None, []
    if kind == "json":
        return kind, kept(json_source.json_fields(request.entity, json_source.read_json(spark, request.path, request.sample, request.entity)), "json-fields"), None, []
    if kind == "parquet":
        return kind, declared.parquet_fields(spark, request.path, request.entity), None, []
    found, said = declared.avro_fields(spark, request.path, request.entity)
    return kind, found, said, []


def renamed(rows: DataFrame, request: Request) -> DataFrame:
    """Fields with final names at the top level; nested ones keep theirs."""
    table = N.table_name(F.lit(request.domain), F.lit(request.entity), F.lit(request.layer))
    top = N.with_final_names(rows.where("depth = 1").withColumn("table_name", table)).select("ord", F.col("path").alias("root"), "final_name")
    root = F.substring_index("path", ".", 1)
    out = rows.withColumn("root", root).join(top.select("root", "final_name").dropDuplicates(["root"]), "root", "left")
    name = F.when(F.col("depth") == 1, F.col("final_name")).otherwise(F.col("name"))
    return out.withColumn("name", name).withColumn("path", F.concat("final_name", F.expr("substring(path, length(root) + 1)"))).drop("root", "final_name")


def process(spark: SparkSession, request: Request) -> dict:
    """Run a request and return its summary; artifacts are under ``artifacts`` by file name."""
    began, request_id = time.time(), uuid.uuid4().hex
    LOG.info("STARTED %s %s", request_id, request.entity)
    kind, out, error = None, {}, None
    try:
        request.check()
        kind, rows, said, bad = read_fields(spark, request)
        if bad:
            out = {"status": "ROW_WIDTH_MISMATCH", "confirm_required": True, "sample": bad[0]}
            return out
        wrong = fields.source_errors(rows.where("depth = 1")).first()
        if wrong:
            raise ValueError(wrong.error)
        out = _govern(spark, request, kind, rows, request.table_description or said)
        return out
    except Exception as e:
        error = str(e)
        LOG.error("FAILED %s %s", request_id, error)
        raise
    finally:
        seconds = round(time.time() - began, 4)
        if out:
            out |= {"request_id": request_id, "duration_seconds": seconds}
            LOG.info("COMPLETED %s %s", request_id, out.get("decision"))
        if request.audit and not request.preview:
            row = (request_id, None, request.user_id, request.entity, request.path, kind, request.policy, out.get("decision"), "FAILED" if error else out.get("status"), out.get("version"), seconds, error)
            spark.createDataFrame([row], AUDIT_SCHEMA).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(request.audit)


def _govern(spark: SparkSession, request: Request, kind: str, rows: DataFrame, description: str | None) -> dict:
    if "row_count" not in rows.columns:
        rows = rows.withColumn("row_count", F.lit(None).cast("long"))
    for ratio in ("distinct_ratio", "null_ratio"):
        if ratio not in rows.columns:
            rows = rows.withColumn(ratio, F.lit(None).cast("double"))
    # One row a column: kept, so that later steps do not read the data again.
    rows = fields.with_targets(fields.with_metadata_columns(renamed(rows, request))).cache()
    try:
        return _decided(spark, request, kind, rows, description)
    finally:
        rows.unpersist()


def _decided(spark: SparkSession, request: Request, kind: str, rows: DataFrame, description: str | None) -> dict:
    dataset, table = spark.range(1).select(
        N.dataset_name(*map(F.lit, (request.domain, request.environment, request.zone))), N.table_name(*map(F.lit, (request.domain, request.entity, request.layer)))
    ).first()
    found = advice.partition_advice(rows, request.zone, request.exclude_metadata)
    override = request.partition_override
    if override == "SKIP":
        partitioning = {"strategy": None, "granularity": None, "confidence": "SKIPPED"}
    elif isinstance(override, dict):
        partitioning = advice.manual_partitioning(**override)
    else:
        partitioning = found.drop("entity").first().asDict()
        if kind == "avro":
            partitioning["notes"] = AVRO_PARTITION_NOTE
    why = None
    if request.cluster_override is not None:
        why = None if request.cluster_override else NO_CLUSTERING["skipped"]
        clustering = [{"column": c, "reason": "User override", "confidence": "USER_DEFINED"} for c in request.cluster_override[:4]]
    else:
        hints = [(request.entity, c, use) for use, cols in (request.query_patterns or {}).items() for c in cols]
        hinted = spark.createDataFrame(hints, "entity string, name string, use string") if hints else None
        clustering = [r.asDict() for r in advice.cluster_advice(rows, found, hinted).orderBy("rank").collect()]
        if not clustering:
            why = advice.cluster_outcomes(rows, found, hinted).first().reason
    note = DECLARED_CLUSTER_NOTE if kind in ("avro", "parquet") else None
    told = {"clustering_reason": why, "clustering_notes": note}
    if request.preview:
        return {"status": "PREVIEW", "format": kind, "partitioning": partitioning, "clustering": clustering, **told}
    classes = [r.asDict() for r in governance.classify(rows.where("depth = 1")).orderBy("ord").select("name", "classification", "category", "confidence", "control").collect()]
    governance.check(rows, spark.createDataFrame([(request.entity, description)], "entity string, description string"))
    deepest = rows.agg(F.max("depth")).first()[0]
    columns = [json.loads(r.json) for r in render_rows.column_json(rows, deepest).orderBy("ord").collect()]
    names = spark.createDataFrame([(request.entity, dataset, table, description)], "entity string, dataset string, table string, description string")
    verdict = _version(spark, request, columns, names)
    out = {
        "format": kind, "dataset": dataset, "table": table, "columns": columns, "partitioning": partitioning, "clustering": clustering, **told, "classification": classes,
        "security": {k: any(c["category"] == v for c in classes) for k, v in (("has_pii", "PII"), ("has_sensitive", "SENSITIVE"), ("has_unknown", "UNKNOWN"))}, **verdict, "artifacts": {},
    }
    if verdict["status"] == "WARNING":
        LOG.warning("WARNING %s breaking change: %s", request.entity, ", ".join(c["change"] for c in verdict["changes"] if c["breaking"]))
        return out
    statements = verdict["statements"]
    wanted = request.output_type
    made = out["artifacts"]
    if wanted in ("JSON", "ALL_FORMATS"):
        made["schema.json"] = render.as_json(columns)
    if wanted in ("YAML", "ALL_FORMATS"):
        made["schema.yaml"] = render.as_yaml(columns)
    if wanted in ("DDL", "ALL_FORMATS"):
        if statements:
            made["migration.sql"] = "\n".join(statements) + "\n"
        if not (statements and verdict["decision"] == "NON_BREAKING"):
            chosen = partitioning if request.apply_partitioning else {}
            by = spark.createDataFrame([(request.entity, *(chosen.get(k) for k in ("strategy", "column", "column_type")))], "entity string, strategy string, column string, column_type string")
            kept = clustering if request.apply_clustering else []
            within = spark.createDataFrame([(request.entity, i, c["column"]) for i, c in enumerate(kept)], "entity string, rank int, column string")
            one = lambda made: made.first().ddl + "\n"
            made["create_table.sql"] = one(render_rows.create_schemas(names)) + "\n" + one(render_rows.create_tables(rows, names, by, within, deepest))
            made["create_table_spark.sql"] = one(render_rows.create_spark_tables(rows, names, by, within, deepest))
    if wanted in ("DOCUMENTATION", "ALL_FORMATS"):
        facts = {"domain": request.domain, "environment": request.environment, "zone": request.zone, "layer": request.layer, "partitioning": partitioning, "clustering": [c["column"] for c in clustering], "entity": request.entity, "version": f"v{verdict['version']}", "decision": verdict["decision"], "policy": request.policy}
        raw = {r.raw_name: r["name"] for r in rows.where("depth = 1").orderBy("ord").collect() if r["name"] not in METADATA_NAMES}
        made["documentation.md"] = render.markdown(table, columns, facts, description, classes, raw, METADATA_NAMES)
    return out


def schema_of(spark: SparkSession, entity: str, columns: list[dict]) -> DataFrame:
    """Top-level rows of nested columns, with digests of what is inside them."""
    return governance.with_nested(spark.createDataFrame(path_rows(entity, columns), PATH_SCHEMA))


def _version(spark: SparkSession, request: Request, columns: list[dict], names: DataFrame) -> dict:
    """Decision, status, version, changes and migrations; the registry is written last, after all that can fail."""
    first = {"decision": "CREATE", "status": "SUCCESS", "version": 1, "changes": [], "statements": []}
    if not request.registry:
        return first
    registry = Registry(spark, request.registry)
    now = registry.current(request.entity)
    if now is None:
        return first | {"version": registry.put(request.entity, columns, summary="initial version")}
    known = spark.createDataFrame([(request.entity, now.schema, now.inside)], "entity string, schema string, inside array<string>")
    old, new = governance.known_columns(known), schema_of(spark, request.entity, columns)
    changes = governance.diff(old, new)
    verdict = governance.decisions(spark.createDataFrame([(request.entity, now.version)], "entity string, version int"), new, changes, request.policy).first()
    listed = [r.asDict() for r in changes.orderBy("name").collect()]
    out = {"decision": verdict.decision, "status": verdict.status, "version": verdict.version, "changes": listed, "statements": []}
    if verdict.status == "REFUSED":
        raise governance.DriftRefused(f"{request.entity}: breaking change: " + ", ".join(f"{c['change']} {c['name']}" for c in listed if c["breaking"]))
    if verdict.status == "SUCCESS" and verdict.decision != "NO_OP":
        moves = render_rows.migrations(changes, names).orderBy("name").collect()
        if refused := [m.refused for m in moves if m.refused]:
            raise ValueError(refused[0])
        out["statements"] = [m.statement for m in moves]
        out["version"] = registry.put(request.entity, columns, verdict.decision == "BREAKING", ",".join(c["change"] for c in listed), in_place=verdict.decision == "NON_BREAKING")
    return out


def write_artifacts(out: dict, folder: str) -> list[str]:
    """Artifacts and ``run_summary.json`` in a local folder; returns the file names."""
    os.makedirs(folder, exist_ok=True)
    for name in ARTIFACTS:  # none of an earlier run stays
        if os.path.exists(os.path.join(folder, name)):
            os.remove(os.path.join(folder, name))
    files = out.get("artifacts", {}) | {"run_summary.json": json.dumps({k: v for k, v in out.items() if k != "artifacts"}, indent=2, default=str)}
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return sorted(files)
