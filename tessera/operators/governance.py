"""Classification, validation, schema diffs, drift policies and registry rows, as DataFrames."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import standards as S
from tessera.operators.nesting import fold, joined, with_path


class SchemaInvalid(ValueError):
    """A schema that breaks a rule, in strict mode."""


class DriftRefused(RuntimeError):
    """A breaking change under the STRICT policy."""


def classification(name: Column, description: Column) -> Column:
    """struct(classification, category, confidence, control) by the first rule that fits."""
    text = F.lower(F.concat(name, F.lit(" "), F.coalesce(description, F.lit(""))))
    made = lambda cls, category, sure, control: F.struct(F.lit(cls).alias("classification"), F.lit(category).alias("category"), F.lit(sure).alias("confidence"), F.lit(control).alias("control"))
    case = F.when(F.lower(name).isin(*S.METADATA_NAMES), made("NON_PII", "NON_PII", "HIGH", "NONE"))
    for cls, patterns, sure, control in S.CLASS_RULES:
        case = case.when(text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)), made(cls, cls.split(".")[0], sure, control))
    flagged = reduce(lambda a, b: a | b, (text.contains(w) for w in S.RED_FLAGS))
    return case.when(flagged, made("UNKNOWN", "UNKNOWN", "MEDIUM", "REVIEW_REQUIRED")).otherwise(made("NON_PII", "NON_PII", "LOW", "NONE"))


def classify(fields: DataFrame) -> DataFrame:
    found = classification(F.col("name"), F.col("description"))
    return fields.withColumn("__c", found).select("*", "__c.*").drop("__c")


def security_summary(classified: DataFrame) -> DataFrame:
    """For each entity, whether it has personal, sensitive or unknown columns, and which."""
    has = lambda c: F.coalesce(F.bool_or(F.col("category") == c), F.lit(False))
    named = F.array_sort(F.collect_list(F.when(F.col("category") != "NON_PII", F.struct("ord", "name"))))
    return classified.groupBy("entity").agg(
        has("PII").alias("has_pii"), has("SENSITIVE").alias("has_sensitive"), has("UNKNOWN").alias("has_unknown"), F.array_join(F.transform(named, lambda x: x["name"]), ",").alias("columns"),
    )


def column_violations(fields: DataFrame) -> DataFrame:
    """``(entity, rule, column, detail)``: every broken rule of a column, however many its table has."""
    top = fields.where("depth = 1")
    name, text = F.col("name"), F.trim(F.lower("description"))
    decimal = F.col("data_type") == "DECIMAL"
    checks = (
        ("V1_DECIMAL", decimal & (F.col("precision").isNull() | (F.col("scale") > F.col("precision"))), F.concat_ws(",", "precision", "scale")),
        ("V5_RANGE", (F.col("bq_type") == "RANGE") & ~F.coalesce(F.col("range_element").isin("DATE", "TIMESTAMP"), F.lit(False)), F.col("range_element")),
        ("V6_NAME_LENGTH", F.length(name) > S.MAX_NAME, F.length(name).cast("string")),
        ("V6_NAME_FORMAT", ~name.rlike(r"^[a-z_][a-z0-9_]*\z"), name),
        ("V7_TYPE", ~F.col("bq_type").isin(*S.TARGET_TYPES), F.col("bq_type")),
        ("V8_DESCRIPTION", F.coalesce(F.col("description"), F.lit("")) == "", F.lit("missing")),
        ("V8_DESCRIPTION", text.isin(*S.EMPTY_COLUMN_TEXTS), F.lit("not meaningful")),
        ("V8_DESCRIPTION", (F.col("description") != "") & ~text.isin(*S.EMPTY_COLUMN_TEXTS) & (F.length(text) < S.MIN_COLUMN_TEXT), F.lit("too short")),
    )
    each = F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, broken, detail in checks))
    found = top.select("entity", F.col("name").alias("column"), F.explode(F.array_compact(each)).alias("x")).select("entity", "x.rule", "column", "x.detail")
    same = top.groupBy("entity", F.lower("name").alias("column")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = found.unionByName(same.select("entity", F.lit("V9_DUPLICATE").alias("rule"), "column", F.col("n").cast("string").alias("detail")))
    deep = fields.where((F.col("data_type") == "RECORD") & (F.col("depth") > S.MAX_DEPTH))
    return found.unionByName(deep.select("entity", F.lit("V3_DEPTH").alias("rule"), F.col("path").alias("column"), F.col("depth").cast("string").alias("detail")))


def violations(fields: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``(entity, rule, column, detail)``: every broken rule of columns and of tables. ``tables`` has ``(entity, description)``.

    Rules are numbered in the order in which strict mode looks at them.
    """
    top, found = fields.where("depth = 1"), column_violations(fields)
    size = top.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > S.MAX_COLUMNS)
    found = found.unionByName(size.select("entity", F.lit("V4_COLUMN_COUNT").alias("rule"), F.lit(None).cast("string").alias("column"), F.col("n").cast("string").alias("detail")))
    if tables is not None:
        empty = tables.select("entity").join(top.select("entity").distinct(), "entity", "left_anti")
        found = found.unionByName(empty.select("entity", F.lit("V4_COLUMN_COUNT").alias("rule"), F.lit(None).cast("string").alias("column"), F.lit("0").alias("detail")))
        said = F.trim(F.lower("description"))
        what = F.when(F.coalesce("description", F.lit("")) == "", "missing").when(said.isin(*S.EMPTY_TABLE_TEXTS), "not meaningful").when(F.length(said) < S.MIN_TABLE_TEXT, "too short")
        found = found.unionByName(tables.select("entity", F.lit("V2_TABLE_DESCRIPTION").alias("rule"), F.lit(None).cast("string").alias("column"), what.alias("detail")).where("detail is not null"))
    return found


def check(fields: DataFrame, tables: DataFrame | None = None) -> None:
    """Raise on the first violation by entity, rule and column."""
    first = violations(fields, tables).orderBy("entity", "rule", "column").first()
    if first:
        raise SchemaInvalid(f"{first.entity}: {first.rule}: {first.column or 'table'}: {first.detail}")


def diff(old: DataFrame, new: DataFrame, fix_ignored: bool = False) -> DataFrame:
    """Changes between two sets of ``(entity, name, type, mode, description[, nested])``, one row a column.

    Columns named like a metadata column without its underscore are left out, unless ``fix_ignored``.
    """
    cols = ["type", "mode", "description"] + (["nested"] if "nested" in old.columns and "nested" in new.columns else [])

    def side(df, tag):
        kept = df if fix_ignored else df.where(~F.lower("name").isin(*S.DRIFT_IGNORED))
        return kept.select("entity", "name", F.struct(*cols).alias(tag))

    both = side(old, "old").join(side(new, "new"), ["entity", "name"], "full_outer")
    o, n = F.col("old"), F.col("new")
    kind = (
        F.when(o.isNull(), F.when(n["mode"] == "REQUIRED", "ADD_REQUIRED_COLUMN").otherwise("ADD_NULLABLE_COLUMN"))
        .when(n.isNull(), "REMOVE_COLUMN")
        .when(~o["type"].eqNullSafe(n["type"]), "TYPE_CHANGE")
        .when((o["mode"] == "NULLABLE") & (n["mode"] == "REQUIRED"), "NULLABLE_TO_REQUIRED")
        .when((o["mode"] == "REQUIRED") & (n["mode"] == "NULLABLE"), "REQUIRED_TO_NULLABLE")
        .when(~o["description"].eqNullSafe(n["description"]), "DESCRIPTION_CHANGE")
        .otherwise("NON_BREAKING_MODIFICATION")
    )
    changed = both.where(~o.eqNullSafe(n)).withColumn("change", kind)
    return changed.select(
        "entity", "name", "change", F.col("change").isin("ADD_REQUIRED_COLUMN", "REMOVE_COLUMN", "TYPE_CHANGE", "NULLABLE_TO_REQUIRED").alias("breaking"),
        o["type"].alias("old_type"), n["type"].alias("new_type"), n["mode"].alias("new_mode"), n["description"].alias("new_description"),
    )


def decisions(old: DataFrame, new: DataFrame, changes: DataFrame, policy: str | Column) -> DataFrame:
    """``(entity, policy, decision, status, version)`` of each entity in ``new``; ``old`` has ``(entity, version)``."""
    policy = F.lit(policy) if isinstance(policy, str) else policy
    counts = changes.groupBy("entity").agg(F.bool_or("breaking").alias("breaking"))
    rows = new.select("entity").distinct().join(old.select("entity", "version").distinct(), "entity", "left").join(counts, "entity", "left").withColumn("policy", policy)
    breaking, version = F.coalesce("breaking", F.lit(False)), F.col("version")
    return rows.select(
        "entity", "policy",
        F.when(version.isNull(), "CREATE").when(F.col("breaking").isNull(), "NO_OP").when(~breaking, "NON_BREAKING").otherwise("BREAKING").alias("decision"),
        F.when(version.isNotNull() & breaking, F.when(F.col("policy") == "STRICT", "REFUSED").when(F.col("policy") == "WARN", "WARNING").otherwise("SUCCESS")).otherwise("SUCCESS").alias("status"),
        F.when(version.isNull(), 1).when(breaking & (F.col("policy") == "AUTO"), version + 1).otherwise(version).cast("int").alias("version"),
    )


def _inside(children: Column) -> Column:
    """A digest of the fields inside a record, whatever their order; null where there are none."""
    cells = F.array_sort(F.transform(children, lambda c: c["cell"]))
    return F.when(F.size(children) > 0, F.sha2(F.array_join(cells, "\x1e"), 256))


def _definition(children: Column) -> Column:
    """A column as a JSON object, with the fields inside it."""
    own = F.to_json(F.struct("name", "type", "mode", "description"))
    nested = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"fields":['), joined(children, "schema", ","), F.lit("]}"))
    return F.when(F.size(children) > 0, nested).otherwise(own)


def with_nested(fields: DataFrame) -> DataFrame:
    """Top-level rows of fields by path, with ``nested``, a digest of the fields inside (null where there are none), and ``schema``, their JSON."""
    own = [F.coalesce(c, F.lit("")) for c in ("name", "type", "mode", "description")]
    top = fold(with_path(fields), {"cell": lambda inside: F.concat_ws("\x1f", *own, _inside(inside)), "nested": _inside, "schema": _definition})
    return top.select("entity", "ord", "name", "type", "mode", "description", "nested", "schema")


def recorded(top: DataFrame) -> DataFrame:
    """``(entity, schema_hash, columns, schema, inside)`` of :func:`with_nested`: what a registry holds; ``inside`` has the columns' nested digests in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "schema", F.coalesce("nested", F.lit("")).alias("nested"))))
    texts = top.groupBy("entity").agg(listed.alias("listed")).select(
        "entity", F.concat(F.lit("["), joined(F.col("listed"), "schema", ","), F.lit("]")).alias("schema"), F.transform("listed", lambda c: c["nested"]).alias("inside"),
    )
    return digests(top).join(texts, "entity")


def known_columns(registry: DataFrame) -> DataFrame:
    """The top-level rows that ``(entity, schema, inside)`` of :func:`recorded` was made from."""
    kind = "array<struct<name string, type string, mode string, description string>>"
    rows = registry.select("entity", "inside", F.posexplode(F.from_json("schema", F.lit(kind))).alias("ord", "c"))
    return rows.select("entity", "ord", "c.*", F.nullif(F.element_at("inside", F.col("ord") + 1), F.lit("")).alias("nested"))


def digest_of(fields: DataFrame) -> str:
    """The digest of the one entity in ``fields``; that of no fields where there are none."""
    row = digests(with_nested(fields)).first()
    return row.schema_hash if row else hashlib.sha256(b"").hexdigest()


def digests(fields: DataFrame) -> DataFrame:
    """``(entity, schema_hash, columns)`` of ``(entity, name, type, mode, description[, nested])``, for every entity at once.

    The hash is the SHA-256 of the columns, each its cells joined by U+001F and all sorted by name and joined by U+001E,
    so their order does not matter; a record's last cell is the digest of its fields, see :func:`with_nested`. Names that drift
    checks ignore are left out. This is the one digest that registries hold.
    """
    cells = [F.coalesce(c, F.lit("")) for c in ("name", "type", "mode", "description")] + ([F.col("nested")] if "nested" in fields.columns else [])
    kept = fields.where(~F.lower("name").isin(*S.DRIFT_IGNORED)).select("entity", F.concat_ws("\x1f", *cells).alias("cell"))
    return kept.groupBy("entity").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("cell")), "\x1e"), 256).alias("schema_hash"), F.count(F.lit(1)).alias("columns"))


def next_versions(known: DataFrame, new: DataFrame, changes: DataFrame, policy: str = "AUTO") -> DataFrame:
    """Registry rows to append for every entity at once: ``(entity, version, table_name, schema_hash, breaking, summary, schema, inside)``.

    ``known`` has the latest ``(entity, version, schema_hash)``. An entity with the same hash gets no row, nor does one whose
    breaking change the policy does not let through; a change that breaks nothing is recorded in place, under its version.
    ``schema`` and ``inside`` are those of :func:`recorded` where ``new`` has its columns' definitions.
    """
    said = changes.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("change")), ",").alias("summary"))
    verdict = decisions(known, new, changes, policy).where("status = 'SUCCESS'")
    rows = recorded(new) if "schema" in new.columns else digests(new).withColumns({"schema": F.lit(None).cast("string"), "inside": F.lit(None).cast("array<string>")})
    rows = rows.join(known.select("entity", F.col("schema_hash").alias("was")), "entity", "left").where(~F.col("schema_hash").eqNullSafe(F.col("was")))
    return rows.join(verdict, "entity").join(said, "entity", "left").select(
        "entity", "version", F.concat_ws("_v", "entity", F.col("version").cast("string")).alias("table_name"), "schema_hash", (F.col("decision") == "BREAKING").alias("breaking"), F.coalesce("summary", F.lit("")).alias("summary"), "schema", "inside",
    )


def latest(registry: DataFrame, entity: str = "entity") -> DataFrame:
    """The newest row of each entity: its largest version's last state, by entry of the log where there is one, else by time."""
    by = F.desc("entry") if "entry" in registry.columns else F.desc("at")
    order = Window.partitionBy(entity).orderBy(F.desc("version"), by)
    return registry.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
