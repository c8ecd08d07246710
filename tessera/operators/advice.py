"""Partitioning and clustering advice for every entity at once, from rows of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import standards as S


def _hits(name: Column, hints) -> Column:
    return reduce(lambda a, b: a + b, (F.lower(name).contains(h).cast("int") for h in hints))


def _any(name: Column, hints) -> Column:
    return _hits(name, hints) > 0


def retention(zone: Column) -> Column:
    known = reduce(lambda c, z: c.when(F.lower(zone) == z[0], F.lit(z[1]).cast("int")), S.RETENTION_DAYS.items(), F.when(zone.isNull(), F.lit(90)))
    return known.otherwise(F.lit(None).cast("int"))


def cost_risk(days: Column, partitions: Column, granularity: Column) -> Column:
    hourly = F.when(partitions <= 24 * 30, "LOW").when(partitions <= 24 * S.HOURLY_MAX_DAYS, "MEDIUM").otherwise("HIGH")
    daily = F.when(partitions <= 120, "LOW").when(partitions <= 730, "MEDIUM").otherwise("HIGH")
    return F.when(days.isNull(), "HIGH").when(partitions.isNull(), "MEDIUM").when(granularity == "HOUR", hourly).otherwise(daily)


def cost_note(days: Column, partitions: Column, granularity: Column) -> Column:
    return (
        # The notes' wording.
        F.when(days.isNull(), "No retention policy set for this zone. Define retention to control long-term cost.")
        .when((granularity == "HOUR") & (partitions > 24 * S.HOURLY_MAX_DAYS), "Hourly partitions are high for this retention window. Consider DAY partitioning or lower retention.")
        .when((granularity == "DAY") & (partitions > 730), "High DAY partition count expected. Review retention policy for cost control.")
        .otherwise("Retention and estimated partition count are within expected cost bounds.")
    )


def partition_advice(fields: DataFrame, zone: str | Column = "raw", exclude_metadata: bool = False) -> DataFrame:
    """One row an entity: a DATE column, else a TIMESTAMP column, else ingestion time.

    Of one type the name with most time hints wins, then the first. Metadata columns take part
    unless ``exclude_metadata``.
    """
    zone = F.lit(zone) if isinstance(zone, str) else zone
    name, kind = F.col("name"), F.col("data_type")
    fit = (F.col("depth") == 1) & kind.isin("DATE", "TIMESTAMP") & ~F.col("is_array")
    if exclude_metadata:
        fit &= ~name.isin(*S.METADATA_NAMES)
    order = F.struct((kind == "TIMESTAMP").cast("int").alias("late"), (-_hits(name, S.TIME_HINTS)).alias("hints"), "ord", "name", "data_type")
    best = fields.groupBy("entity").agg(F.min(F.when(fit, order)).alias("best"), F.max("row_count").alias("rows")).withColumn("days", retention(zone))
    window = F.greatest(F.coalesce("days", F.lit(30)), F.lit(1))
    many = (F.col("rows") >= S.HOUR_ROWS) | (F.col("rows") / window >= S.HOUR_ROWS_A_DAY)
    hourly = (F.col("best.data_type") == "TIMESTAMP") & (F.col("days").isNull() | (F.col("days") <= S.HOURLY_MAX_DAYS)) & many
    first = best.withColumn("granularity", F.when(F.coalesce(hourly, F.lit(False)), "HOUR").otherwise("DAY"))
    first = first.withColumn("granularity", F.when((F.col("granularity") == "HOUR") & (F.col("days") * 24 > S.MAX_PARTITIONS), "DAY").otherwise(F.col("granularity")))
    first = first.withColumn("partitions", F.when(F.col("granularity") == "HOUR", F.col("days") * 24).otherwise(F.col("days")))
    over = F.coalesce(F.col("partitions") > S.MAX_PARTITIONS, F.lit(False))
    by_column = F.col("best").isNotNull() & ~over
    return first.select(
        "entity", F.when(by_column, "COLUMN").otherwise("INGESTION_TIME").alias("strategy"), F.when(by_column, F.col("best.name")).alias("column"),
        F.when(by_column, F.col("best.data_type")).alias("column_type"), "granularity", F.col("partitions").alias("estimated_partition_count"),
        cost_risk(F.col("days"), F.col("partitions"), F.col("granularity")).alias("cost_risk"), cost_note(F.col("days"), F.col("partitions"), F.col("granularity")).alias("cost_note"),
        F.when(~by_column, "LOW").when((F.col("best.data_type") == "DATE") | (F.col("granularity") == "HOUR"), "HIGH").otherwise("MEDIUM").alias("confidence"),
    )


def manual_partitioning(column: str | None = None, column_type: str | None = None, granularity: str = "DAY", days: int | None = None, strategy: str = "COLUMN") -> dict:
    """A partition choice made by the user."""
    return {"strategy": strategy, "column": column, "column_type": column_type, "granularity": (granularity or "DAY").upper(), "retention_days": days, "confidence": "USER_DEFINED"}


def cluster_scores(fields: DataFrame, partitioning: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """Scores and reasons of the columns that can be clustered.

    ``hints`` has ``(entity, name, use)``; use is joins, filters or group_by.
    """
    name = F.col("name")
    rows = fields.where((F.col("depth") == 1) & ~F.col("is_array") & ~F.upper("data_type").isin(*S.UNCLUSTERABLE) & ~F.lower("name").isin(*S.METADATA_NAMES) & ~_any(name, S.METRIC_HINTS))
    if partitioning is not None:
        taken = partitioning.where("column is not null").select("entity", F.col("column").alias("name"))
        rows = rows.join(taken, ["entity", "name"], "left_anti")
    if hints is not None:
        used = hints.groupBy("entity", "name").agg(F.collect_set("use").alias("uses"))
        rows = rows.join(used, ["entity", "name"], "left")
    else:
        rows = rows.withColumn("uses", F.lit(None).cast("array<string>"))
    uses = F.coalesce("uses", F.array().cast("array<string>"))
    high, low = _any(name, S.HIGH_HINTS), _any(name, S.LOW_HINTS)
    terms = (
        (F.col("distinct_ratio") > 0.7, 4, "High distinct ratio"), (F.col("distinct_ratio") < 0.05, -3, "Very low distinct ratio"), (F.col("null_ratio") > 0.6, -2, "High null ratio"),
        (high, 1, "Identifier-like name"), (~high & low, -1, None), (F.array_contains(uses, "joins"), 3, "Used in joins"),
        (F.array_contains(uses, "filters"), 2, "Used in filters"), (F.array_contains(uses, "group_by"), 1, "Used in GROUP BY"),
    )
    score = reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n, _ in terms))
    said = F.array_join(F.array_compact(F.array(*(F.when(c, r) for c, _, r in terms if r))), "; ")
    return rows.select("entity", "ord", "name", score.alias("score"), F.when(said == "", "Low signal").otherwise(said).alias("reason"))


def cluster_advice(fields: DataFrame, partitioning: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """Up to four columns an entity, the best first; entities without one have no row."""
    order = Window.partitionBy("entity").orderBy(F.desc("score"), "ord")
    ranked = cluster_scores(fields, partitioning, hints).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= S.MAX_CLUSTER_COLUMNS)
    best = F.max("score").over(Window.partitionBy("entity"))
    return ranked.select("entity", "rank", F.col("name").alias("column"), "score", "reason", F.when(best >= 7, "HIGH").when(best >= 4, "MEDIUM").otherwise("LOW").alias("confidence"))


def cluster_outcomes(fields: DataFrame, partitioning: DataFrame | None = None, hints: DataFrame | None = None, declared: bool = False) -> DataFrame:
    """One row an entity: ``(entity, suggested, columns, confidence, reason, notes)``, also where nothing is suggested.

    ``declared`` says that fields come from Avro or Parquet schemas, without statistics.
    """
    scored = cluster_scores(fields, partitioning, hints).groupBy("entity").agg(F.count_if(F.col("score") > 0).alias("good"))
    chosen = cluster_advice(fields, partitioning, hints).groupBy("entity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "column"))), lambda x: x["column"]), ",").alias("columns"), F.first("confidence").alias("confidence"),
    )
    rows = fields.select("entity").distinct().join(scored, "entity", "left").join(chosen, "entity", "left")
    return rows.select(
        "entity", F.col("columns").isNotNull().alias("suggested"), "columns", "confidence",
        F.when(F.col("good").isNull(), S.NO_CLUSTERING["none eligible"]).when(F.col("good") == 0, S.NO_CLUSTERING["low benefit"]).alias("reason"),
        F.lit(S.DECLARED_CLUSTER_NOTE if declared else None).cast("string").alias("notes"),
    )
