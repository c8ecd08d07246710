"""Drift watching over arriving files: the types that each micro-batch's values support are set against the registry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fields, governance
from tessera.operators.profile import as_text, finished, profile, states, united
from tessera.operators.registry import Registry
from tessera.plans.process import schema_of

VERDICT = "entity string, policy string, decision string, status string, version int, changes string"


def columns_of_batch(batch: DataFrame, entity: str) -> list[dict]:
    """The target columns of a batch: text columns by what their values support, others as declared; one row a column."""
    spark = batch.sparkSession
    rows = fields.declared_fields(spark, {entity: batch}).where("depth = 1")
    text = [n for n, t in batch.dtypes if t == "string"]
    if text:
        found = profile(batch, text).select(F.col("name").alias("path"), F.col("data_type").alias("found"))
        rows = rows.join(found, "path", "left").withColumn("data_type", F.coalesce("found", "data_type")).drop("found")
    rows = fields.with_targets(fields.with_metadata_columns(rows.withColumn("row_count", F.lit(0).cast("long"))))
    return [r.asDict() for r in rows.orderBy("ord").select("name", F.col("bq_type").alias("type"), "mode", "description").collect()]


def judge(batch: DataFrame, entity: str, registry_path: str, policy: str = "WARN") -> tuple:
    """A VERDICT row for a batch; the registry gets a version where the policy lets the change through."""
    spark = batch.sparkSession
    columns, registry = columns_of_batch(batch, entity), Registry(spark, registry_path)
    now = registry.current(entity)
    new = schema_of(spark, entity, columns)
    old = governance.known_columns(spark.createDataFrame([(entity, now.schema, now.inside)] if now else [], "entity string, schema string, inside array<string>"))
    changes = governance.diff(old, new)
    known = spark.createDataFrame([(entity, now.version)] if now else [], "entity string, version int")
    verdict = governance.decisions(known, new, changes, policy).first()
    listed = [r.asDict() for r in changes.orderBy("name").select("name", "change", "breaking", "old_type", "new_type").collect()] if now else []
    if verdict.status == "SUCCESS":
        registry.put(entity, columns, verdict.decision == "BREAKING", ", ".join(c["change"] for c in listed), in_place=verdict.decision == "NON_BREAKING")
    return entity, policy, verdict.decision, verdict.status, verdict.version, json.dumps(listed)


def profiled(spark: SparkSession, report_path: str) -> DataFrame:
    """The profile of all batches so far, from their stored states; no row is read again."""
    keys = ("entity", "ord", "name")
    return finished(united(spark.read.parquet(f"{report_path}/states"), keys), keys)


def watch(stream: DataFrame, entity: str, registry_path: str, report_path: str, checkpoint: str, policy: str = "WARN"):
    """Start a query that writes under ``report_path`` a verdict of each batch and the state of its columns, see :func:`profiled`.

    A breaking batch is refused (STRICT), warned of (WARN) or makes a new version (AUTO); the stream goes on. What is written
    carries the batch's number, so a repeated batch overwrites its own; a repeated verdict finds its own version and is a NO_OP.
    Batches without rows are passed over.
    """
    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        made = spark.createDataFrame([judge(batch, entity, registry_path, policy)], VERDICT)
        made.coalesce(1).write.mode("overwrite").parquet(f"{report_path}/verdict/batch={number}")
        states(as_text(batch)).withColumn("entity", F.lit(entity)).write.mode("overwrite").parquet(f"{report_path}/states/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
