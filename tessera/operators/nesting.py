"""Nested fields as rows of paths, folded from the deepest level up.

A fold makes texts of every field out of its own row and of what was made of the fields inside it, with one grouped step for
each depth, for all entities at once. A record's fields come together in one row; there are ten thousand of them at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH_SCHEMA = "entity string, ord int, path string, depth int, name string, type string, mode string, description string, range_element string"


def parent_path() -> Column:
    """The path of the record around a nested field: its own without its name, whatever that holds."""
    return F.expr("left(path, length(path) - length(name) - 1)")


def with_path(fields: DataFrame) -> DataFrame:
    """Fields with path and depth; flat ones have their name and 1."""
    return fields if "path" in fields.columns else fields.withColumns({"path": F.col("name"), "depth": F.lit(1)})


def fold(fields: DataFrame, made: dict[str, Callable[[Column], Column]], order: str = "ord", deepest: int | None = None) -> DataFrame:
    """Top-level rows with the text columns ``made``.

    Each function gets the texts of the fields inside, as a list of structs ordered by ``order``; it is empty for what is
    not a record. ``deepest`` saves looking for the greatest depth.
    """
    fields = with_path(fields)
    if deepest is None:
        deepest = fields.agg(F.max("depth")).first()[0] or 1
    empty = F.array().cast(f"array<struct<`{order}`:{fields.schema[order].dataType.simpleString()}{''.join(f',`{c}`:string' for c in made)}>>")
    inside = None
    for depth in range(deepest, 0, -1):
        level = fields.where(F.col("depth") == depth)
        level = level.withColumn("children", empty) if inside is None else level.join(inside, ["entity", "path"], "left").withColumn("children", F.coalesce("children", empty))
        level = level.withColumns({name: text(F.col("children")).cast("string") for name, text in made.items()}).drop("children")
        if depth > 1:
            inside = level.select("entity", parent_path().alias("path"), F.struct(order, *made).alias("child")).groupBy("entity", "path").agg(F.array_sort(F.collect_list("child")).alias("children"))
    return level


def joined(children: Column, name: str, between: str) -> Column:
    return F.array_join(F.transform(children, lambda c: c[name]), between)


def path_rows(entity: str, columns: list[dict]) -> list[tuple]:
    """Rows of PATH_SCHEMA of nested columns ``{name, type, mode[, description, fields, rangeElementType]}``."""
    out: list[tuple] = []

    def walk(cs: list[dict], prefix: str, depth: int) -> None:
        for c in cs:
            element = (c.get("rangeElementType") or {}).get("type")
            out.append((entity, len(out), prefix + c["name"], depth, c["name"], c["type"], c.get("mode") or "NULLABLE", c.get("description"), element))
            walk(c.get("fields") or [], f"{prefix}{c['name']}.", depth + 1)

    walk(columns, "", 1)
    return out
