"""Fixed values of the schema standard: what they are decides results, so they are stated as they are."""

# Metadata columns (name, type, mode, description), in order.
METADATA_COLUMNS = (
    ("_ingestion_timestamp", "TIMESTAMP", "REQUIRED", "Timestamp when the record was ingested into the platform"),
    ("_source_system", "STRING", "REQUIRED", "Identifier of the source system providing the data"),
    ("_batch_id", "STRING", "REQUIRED", "Unique identifier for the ingestion batch"),
    ("_record_hash", "STRING", "REQUIRED", "Hash of record content used for change detection"),
    ("_is_deleted", "BOOLEAN", "REQUIRED", "Logical delete indicator for soft-deleted records"),
    ("_deleted_timestamp", "TIMESTAMP", "REQUIRED", "Timestamp when the record was logically deleted"),
    ("_op_type", "STRING", "REQUIRED", "CDC operation type: INSERT, UPDATE, or DELETE"),
    ("_op_ts", "TIMESTAMP", "REQUIRED", "Timestamp when the CDC operation occurred (UTC)"),
)
METADATA_NAMES = tuple(c[0] for c in METADATA_COLUMNS)

# Names that drift checks leave out, without the leading underscore.
DRIFT_IGNORED = tuple(n.removeprefix("_") for n in METADATA_NAMES)

# Reserved words of the warehouse dialect.
RESERVED_WORDS = (
    "all", "and", "any", "array", "as", "asc", "assert_rows_modified", "at", "between", "by", "case", "cast", "collate", "contains", "create",
    "cross", "cube", "current", "default", "define", "desc", "distinct", "else", "end", "enum", "escape", "except", "exclude", "exists", "extract",
    "false", "fetch", "following", "for", "from", "full", "group", "grouping", "groups", "hash", "having", "if", "ignore", "in", "inner", "intersect",
    "interval", "into", "is", "join", "lateral", "left", "like", "limit", "lookup", "merge", "natural", "new", "no", "not", "null", "nulls", "of",
    "on", "or", "order", "outer", "over", "partition", "preceding", "proto", "qualify", "range", "recursive", "respect", "right", "rollup", "rows",
    "select", "set", "some", "struct", "tablesample", "then", "to", "treat", "true", "unbounded", "union", "unnest", "using", "when", "where",
    "window", "with", "within", "insert", "update", "delete", "drop", "alter", "table",
)

# Classification rules in order: class, patterns, confidence, control.
CLASS_RULES = (
    ("PII.EMAIL", (r"\bemail\b", r"e_mail"), "HIGH", "RESTRICTED_ACCESS"),
    ("PII.NAME", (r"\bname\b", r"full_name"), "MEDIUM", "RESTRICTED_ACCESS"),
    ("PII.DOB", (r"\bdob\b", r"date_of_birth", r"birth"), "HIGH", "MASK_OR_RESTRICT"),
    ("PII.PHONE", (r"phone", r"mobile", r"contact"), "HIGH", "RESTRICTED_ACCESS"),
    ("PII.ADDRESS", (r"address", r"addr"), "MEDIUM", "MASK_OR_RESTRICT"),
    ("PII.NATIONAL_ID", (r"aadhaar", r"\bssn\b", r"\bpan\b"), "HIGH", "HIGHLY_RESTRICTED"),
    ("SENSITIVE.PASSWORD", (r"password", r"passwd", r"pwd"), "HIGH", "DENY_ALL_EXCEPT_SERVICE"),
    ("SENSITIVE.TOKEN", (r"token", r"secret", r"api_key"), "HIGH", "DENY_ALL_EXCEPT_SERVICE"),
    ("SENSITIVE.FINANCIAL", (r"salary", r"cost_price", r"revenue"), "MEDIUM", "RESTRICTED_ACCESS"),
    ("SENSITIVE.SECURITY", (r"ssn_hash", r"encryption_key"), "HIGH", "HIGHLY_RESTRICTED"),
)
RED_FLAGS = ("secret", "key", "hash", "token", "auth", "credential", "private", "confidential", "internal")

# Partitioning policy.
TIME_HINTS = ("date", "time", "created", "event", "order", "transaction")
RETENTION_DAYS = {"raw": 90, "curated": 365, "analytics": None}
MAX_PARTITIONS, HOURLY_MAX_DAYS = 10_000, 180
HOUR_ROWS, HOUR_ROWS_A_DAY = 50_000_000, 5_000_000

# Clustering policy.
MAX_CLUSTER_COLUMNS = 4
UNCLUSTERABLE = ("DATE", "TIMESTAMP", "DATETIME", "BOOLEAN", "BOOL", "FLOAT", "FLOAT64", "NUMERIC", "BIGNUMERIC")
METRIC_HINTS = ("amount", "price", "score", "metric", "value", "total", "avg", "sum")
LOW_HINTS = ("status", "type", "flag", "category", "level")
HIGH_HINTS = ("id", "uuid", "key")

# Validation limits.
TARGET_TYPES = ("STRING", "INTEGER", "FLOAT", "NUMERIC", "BIGNUMERIC", "BOOLEAN", "DATE", "TIMESTAMP", "DATETIME", "RECORD", "JSON", "GEOGRAPHY", "RANGE")
MAX_NAME, MAX_COLUMNS, MAX_DEPTH, MIN_TABLE_TEXT, MIN_COLUMN_TEXT = 300, 10_000, 13, 20, 10
EMPTY_TABLE_TEXTS = ("table", "data", "dataset", "tbd", "todo", "unknown")
EMPTY_COLUMN_TEXTS = ("todo", "tbd", "unknown", "n/a", "na", "none")
OVERRIDE_TYPES = ("STRING", "INTEGER", "FLOAT", "DECIMAL", "BOOLEAN", "DATE", "TIMESTAMP", "JSON", "RECORD")

# Why nothing is suggested for clustering, and notes for formats that declare their schema.
NO_CLUSTERING = {
    "none eligible": "No columns met the minimum clustering suitability threshold",
    "low benefit": "All eligible columns had low or unknown clustering benefit",
    "skipped": "User explicitly skipped clustering",
}
DECLARED_CLUSTER_NOTE = "Data-driven cardinality stats were not computed for Avro/Parquet in this run. Recommendation is based on schema/query heuristics only."
AVRO_PARTITION_NOTE = "For Avro input, volume-based DAY/HOUR partition recommendation is heuristic in this run because exact row_count was not computed to avoid expensive full-file scan."

# Boolean words, texts that stand for null, shapes of geometry and of date ranges.
TRUE_FALSE = ("true", "false", "0", "1", "yes", "no", "y", "n", "t", "f")
NULL_TEXTS = ("", "NULL", "null", "Null")
SHAPE = r"^(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION)\("
RANGE = r"(?U)^[\[(]\s*\d{4}-\d{2}-\d{2}\s*,\s*\d{4}-\d{2}-\d{2}\s*[)\]]\z"
