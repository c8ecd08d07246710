"""Files of a schema: JSON, YAML and Markdown of its columns, which ``render_rows`` makes with all statements.

Columns are plain dicts ``{name, type, mode[, description, fields, rangeElementType]}``. The wording is fixed, since others read it.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

import yaml


def as_json(columns: list[dict]) -> str:
    return json.dumps(columns, indent=2, ensure_ascii=False)


def as_yaml(columns: list[dict]) -> str:
    return yaml.safe_dump(columns, sort_keys=False, allow_unicode=True)


def markdown(title: str, columns: list[dict], facts: dict, description: str | None = None, classes: list[dict] | None = None,
             renamed: dict[str, str] | None = None, system: tuple[str, ...] = (), at: datetime | None = None) -> str:
    """Documentation: overview, properties, version, security, business and system columns, names, metadata."""
    lines = [f"# {title}", "", "## Overview", description or "No description provided.", "", "---", "", "## Table Properties", ""]
    lines += [f"- **{k}**: {facts.get(k.lower().replace(' ', '_'), 'N/A')}" for k in ("Domain", "Environment", "Zone", "Layer")]
    p = facts.get("partitioning") or {}
    if p.get("strategy") == "COLUMN":
        lines.append(f"- **Partitioning**: {p.get('granularity')}({p.get('column')})")
    elif p.get("strategy"):
        lines.append(f"- **Partitioning**: {p['strategy']}")
    if facts.get("clustering"):
        lines.append("- **Clustering**: " + ", ".join(facts["clustering"]))
    lines += ["", "---", "", "## Versioning Information", ""]
    lines += [f"- **{k}**: {facts.get(v) or 'N/A'}" for k, v in (("Entity", "entity"), ("Version", "version"), ("Decision", "decision"), ("Drift Policy Applied", "policy"))]
    found = [c for c in classes or [] if c["category"] != "NON_PII"]
    lines += ["", "---", "", "## Security & Governance", "", "### Classification Summary", "", f"- **Total Columns**: {len(classes or columns)}", f"- **Classified Columns**: {len(found)}", ""]
    if found:
        lines += ["### Classified Columns", "", "| Column | Classification | Category | Confidence | Recommended Control |", "|---|---|---|---|---|"]
        lines += ["| " + " | ".join(c[k] for k in ("name", "classification", "category", "confidence", "control")) + " |" for c in found]
    else:
        lines.append("_No PII or sensitive fields detected._")

    def rows(cs, prefix=""):
        for c in cs:
            yield f"| {prefix}{c['name']} | {c['type']} | {c['mode']} | {(c.get('description') or '').replace('|', chr(92) + '|')} |"
            yield from rows(c.get("fields") or [], f"{prefix}{c['name']}.")

    for heading, part in (("Business Columns", [c for c in columns if c["name"] not in system]), ("System / Metadata Columns", [c for c in columns if c["name"] in system])):
        if part:
            lines += ["", "---", "", f"## {heading}", "", "| Column Name | Data Type | Mode | Description |", "|---|---|---|---|", *rows(part)]
    if changed := {k: v for k, v in (renamed or {}).items() if k != v}:
        lines += ["", "---", "", "## Naming Normalization", "", "| Original Column | Standardized Column |", "|---|---|", *(f"| {k} | {v} |" for k, v in changed.items())]
    lines += ["", "---", "", "## Metadata", "", f"- **Generated At (UTC)**: {(at or datetime.now(UTC)).strftime('%Y-%m-%d %H:%M:%S')}"]
    return "\n".join(lines) + "\n"
