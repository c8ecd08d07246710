"""``python -m tessera.cli request.yaml out/``: run one request, or a list of them, from a YAML or JSON file."""

from __future__ import annotations

import os
import sys

import yaml
from pyspark.sql import SparkSession

from tessera.plans.process import Request, process, write_artifacts


def _override(asked: dict, manual):
    """None for AUTO, what ``manual`` makes of the part otherwise; SKIP is told by the caller."""
    return manual(asked) if asked.get("mode", "AUTO") == "MANUAL" else None


def request_of(asked: dict) -> Request:
    """A request from its own fields, or from a file with the parts source, settings, partitioning and clustering."""
    if "source" not in asked:
        return Request(**asked)
    known = {"entity", "domain", "environment", "zone", "layer", "output", "source", "settings", "partitioning", "clustering"}
    if extra := sorted(asked.keys() - known):
        raise ValueError("unknown parts: " + ", ".join(extra))
    source, settings, by, within = (asked.get(part) or {} for part in ("source", "settings", "partitioning", "clustering"))
    kept = {name: settings[name] for name in ("table_description", "type_overrides", "registry", "audit") if settings.get(name)}
    choice = _override(by, lambda p: {k: v for k, v in p.items() if k in ("strategy", "column", "column_type", "granularity") and v is not None})
    return Request(
        path=source.get("file_path"), csv=source.get("csv_override") or {}, policy=settings.get("drift_policy") or "WARN", output_type=asked.get("output") or "ALL_FORMATS", user_id="config_executor",
        partition_override="SKIP" if by.get("mode") == "SKIP" else choice, cluster_override=[] if within.get("mode") == "SKIP" else _override(within, lambda c: list(c.get("columns") or [])),
        **{name: asked.get(name) for name in ("entity", "domain", "environment", "zone", "layer")}, **kept,
    )


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if len(args) != 2:
        print(__doc__)
        return 2
    with open(args[0]) as f:
        asked = yaml.safe_load(f)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    many = asked if isinstance(asked, list) else [asked]
    for one in many:
        request = request_of(one)
        out = process(spark, request)
        folder = os.path.join(args[1], request.entity) if len(many) > 1 else args[1]
        print(out["status"], out.get("decision", ""), *write_artifacts(out, folder))
    return 0


if __name__ == "__main__":
    sys.exit(main())
