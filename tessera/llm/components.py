"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima with map-side combining and two joins. The minima are staged
before they are joined, so that both join inputs are plain shuffles and adaptive execution can
split the rows of a hub; no neighbourhood is ever gathered in a task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, unstage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node that an edge touches; component is the smallest node.

    Null ends and loops are ignored, repeated edges count once; an empty table gives an empty one.
    """
    now = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "cc",
    )
    seen = _signature(now)
    while seen[0]:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        low = stage(both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-low")
        large = now.join(low, "v").select("u", F.col("m").alias("v")).where("u != v").distinct()
        large = stage(large, "cc-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        joined = large.join(least, "u")
        small = (
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = stage(small, "cc")
        unstage(now, low, large, least)
        now, before = after, seen
        seen = _signature(now)
        if seen == before:
            break
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(now.select(F.col("v"), F.col("v")))
        .distinct()
    )
