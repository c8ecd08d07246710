"""Links within groups of any size, each task with a bounded part of a group.

A linker takes rows of a group, cut by ``pair``, and gives edges that connect what links connect. A
group up to ``most`` is one part. A larger one is cut by hash twice over, in two unlike ways, and each
part is linked on its own: that connects nearly all that belongs together. What then lies outside
the group's largest component is cut again, and each of its parts is set against every part of the
group, so that every pair has met but those within the largest component, which are connected. The rows
sent grow with the group and what is outside that component, not with the square of the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, stage, unstage
from tessera.llm.components import connected_components


def link_groups(rows: DataFrame, link: Callable[[DataFrame], DataFrame], most: int, group: str, ident: str, weight: str | None = None) -> DataFrame:
    """``(a, b)``: edges over ``ident``, from ``rows`` with the columns ``group``, ``ident`` and others that ``link`` reads.

    ``weight`` names a column of sizes; without it a row counts one.
    """
    held = F.sum(weight) if weight else F.count(F.lit(1))
    chunks = F.ceil(F.col("held") / most).cast("long")
    hot = stage(rows.groupBy(group).agg(held.alias("held")).where(F.col("held") > most).select(group, chunks.alias("chunks")), "hot")
    if hot.isEmpty():
        unstage(hot)
        return link(rows.withColumn("pair", F.lit(0).cast("long")))

    def place(way: int, of: str):
        return F.pmod(F.xxhash64(F.lit(way), group, ident), F.col(of))

    parts = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(place(0, "chunks"), F.col("chunks") + place(1, "chunks")))
    dealt = rows.join(broadcast_if_small(hot), group, "left").withColumn("pair", F.explode(parts)).drop("chunks")
    first = stage(link(dealt), "links")
    found = stage(connected_components(first).select(F.col("node").alias(ident), F.col("component").alias("__component")), "links-of")
    inside = rows.join(broadcast_if_small(hot), group).join(found, ident, "left")
    inside = stage(inside.withColumn("__component", F.coalesce("__component", ident)), "hot-rows")
    largest = inside.groupBy(group, "__component").agg(held.alias("held")).groupBy(group).agg(F.max(F.struct("held", "__component"))["__component"].alias("__largest"))
    largest = stage(largest, "hot-largest")
    inside = inside.join(broadcast_if_small(largest), group).withColumn("__outside", F.col("__component") != F.col("__largest")).drop("__component", "__largest")
    rest = stage(inside.where("__outside").groupBy(group).agg(held.alias("held")).select(group, chunks.alias("__rest")), "hot-outside")
    unstage(hot, found)
    if rest.isEmpty():
        return first
    inside = inside.join(broadcast_if_small(rest), group)
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    across = F.transform(count("__rest"), lambda r: r * F.col("chunks") + place(0, "chunks"))
    own = F.transform(count("chunks"), lambda c: place(2, "__rest") * F.col("chunks") + c)
    pairs = F.when(F.col("__outside"), F.array_union(across, own)).otherwise(across)
    return first.unionByName(link(inside.withColumn("pair", F.explode(pairs)).drop("chunks", "__rest", "__outside")))
