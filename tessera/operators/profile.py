"""Column profiles: counts, lengths, digits and the type that a column's text supports.

Every leaf column is read once as text and unpivoted. Predicates on a text come together as the bits of one number,
so a column's type needs no more than the AND and OR of them, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import predicates as P


def as_text(df: DataFrame, columns: list[str] | None = None, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, ord, name, v)``: a row for each cell of the columns that are not kept as they are, as text."""
    names = columns or [c for c in df.columns if c not in keep]
    cells = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.col(f"`{n}`").cast("string").alias("v")) for i, n in enumerate(names)))
    return df.select(*(F.col(f"`{c}`") for c in keep), F.inline(cells))


def counts(df: DataFrame, columns: list[str] | None = None, error: float | None = None) -> DataFrame:
    """The counts, ratios and lengths of a profile, without its types: no predicate runs and no text is shuffled.

    Cells are counted by column and a 64-bit hash of their text, so what moves is a few fixed-width numbers for each
    distinct value. With ``error``, distinct values are estimated to that relative deviation, and only sketches move.
    """
    names = columns or df.columns
    v = F.col("v")
    s = P.strip(v)
    cell = as_text(df, names).select(
        "ord", F.xxhash64(s).alias("h"), (s.isNull() | (s == "")).alias("blank"), v.isNull().alias("missing"),
        (v.isNull() | v.isin(*P.NULL_TEXTS)).alias("dropped"), F.length("v").alias("long"),
    )
    sums = [F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.sum("n_dropped").alias("n_dropped"), F.max(F.when(~F.col("blank"), F.col("long"))).alias("max_length")]
    one = [F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("n_missing"), F.count_if("dropped").alias("n_dropped"), F.max("long").alias("long")]
    if error is None:
        values = cell.groupBy("ord", "blank", "h").agg(*one)
        found = values.groupBy("ord").agg(*sums, F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("n_blank"), F.count_if(~F.col("blank")).alias("n_distinct"))
    else:
        values = cell.groupBy("ord", "blank").agg(*one, F.approx_count_distinct("h", error).alias("values"))
        found = values.groupBy("ord").agg(*sums, F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("n_blank"), F.coalesce(F.max(F.when(~F.col("blank"), F.col("values"))), F.lit(0)).alias("n_distinct"))
    ratio = lambda c: F.rint(F.col(c) / F.col("n") * 10000) / 10000
    return found.select(
        "ord", F.element_at(F.array(*map(F.lit, names)), F.col("ord") + 1).alias("name"), "n", "n_blank", "n_missing", (F.col("n") - F.col("n_dropped")).alias("n_kept"), "n_distinct",
        ratio("n_distinct").alias("distinct_ratio"), ratio("n_blank").alias("null_ratio"), (F.col("n_blank") > 0).alias("nullable"), "max_length",
    )


#: How the columns of a state come together from those of parts, see :func:`states`.
_MERGED = {
    "n": F.sum, "n_blank": F.sum, "n_missing": F.sum, "n_dropped": F.sum, "max_length": F.max, "all_bits": F.bit_and, "any_bits": F.bit_or, "max_digits": F.max, "max_scale": F.max, "max_whole": F.max,
}


def _merged() -> list[Column]:
    return [merge(name).alias(name) for name, merge in _MERGED.items()]


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with more columns, each worked out once: a generator keeps the optimiser from copying what they are into every use."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def _marked(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each cell as fixed-width numbers: a hash of its text, a mask of what it could be, lengths and digits."""
    v = F.col("v")
    rows = cells.select(*keys, v.isNull().alias("missing"), (v.isNull() | v.isin(*P.NULL_TEXTS)).alias("dropped"), F.length("v").alias("long"), "v")
    rows = once(once(rows, s=P.strip(v)), bits=F.when(~F.col("dropped"), P.mask(F.col("s"))))
    decimal = F.col("bits").bitwiseAND(P.BITS["decimal"]) != 0
    unsigned = F.length("s") - F.col("s").rlike("^[+-]").cast("int")
    point = F.locate(".", F.col("s"))
    fraction = F.when(point > 0, F.length("s") - point).otherwise(0)
    return rows.select(
        *keys, "missing", "dropped", "long", "bits", (F.col("s").isNull() | (F.col("s") == "")).alias("blank"), F.xxhash64("s").alias("h"),
        F.when(decimal, unsigned - F.when(point > 0, fraction + 1).otherwise(0)).alias("whole"), F.when(decimal, fraction).alias("fraction"),
    )


def _counted() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("n_blank"), F.count_if("missing").alias("n_missing"), F.count_if("dropped").alias("n_dropped"), F.max(F.when(~F.col("blank"), F.col("long"))).alias("max_length"),
        F.bit_and("bits").alias("all_bits"), F.bit_or("bits").alias("any_bits"), F.max(F.col("whole") + F.col("fraction")).alias("max_digits"), F.max("fraction").alias("max_scale"), F.max("whole").alias("max_whole"),
    ]


def states(cells: DataFrame, keys: tuple[str, ...] = ("ord", "name"), lg: int = 12) -> DataFrame:
    """A row for each column of ``cells`` from which profiles are made: numbers, and a sketch of its distinct values.

    One pass, of which only partial rows are shuffled. States of several batches unite by :func:`united`, so what was read once
    need not be read again. The relative deviation of a sketch is about 1.04 / sqrt(2 ** lg).
    """
    distinct = F.hll_sketch_agg(F.when(~F.col("blank"), F.col("h")), lg)
    return _marked(cells, keys).groupBy(*keys).agg(*_counted(), distinct.alias("sketch"))


def united(parts: DataFrame, keys: tuple[str, ...] = ("ord", "name")) -> DataFrame:
    """One state for each column out of those of many batches, in any order."""
    return parts.groupBy(*keys).agg(*_merged(), F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))


def finished(state: DataFrame, keys: tuple[str, ...] = ("ord", "name")) -> DataFrame:
    """The profile of each column, from its state."""
    distinct = F.col("n_distinct") if "n_distinct" in state.columns else F.hll_sketch_estimate("sketch")
    flag = lambda name: F.coalesce(F.col("all_bits").bitwiseAND(P.BITS[name]) != 0, F.lit(False))
    some = lambda name: F.coalesce(F.col("any_bits").bitwiseAND(P.BITS[name]) != 0, F.lit(False))
    ratio = lambda c: F.rint(c / F.col("n") * 10000) / 10000
    kept = F.col("n") - F.col("n_dropped")
    return state.select(
        *keys, "n", "n_blank", "n_missing", kept.alias("n_kept"), distinct.alias("n_distinct"), ratio(distinct).alias("distinct_ratio"), ratio(F.col("n_blank")).alias("null_ratio"),
        (F.col("n_blank") > 0).alias("nullable"), "max_length", P.inferred_type(kept, flag, some("naive"), some("point")).alias("data_type"),
        ((kept > 0) & flag("zero_one")).alias("ambiguous_boolean"), some("naive").alias("any_naive"), "max_digits", "max_scale", "max_whole", some("minus").alias("signed"),
    )


def profile_cells(cells: DataFrame, keys: tuple[str, ...] = ("ord", "name"), lg: int | None = None) -> DataFrame:
    """A row for each column of ``cells``, see :func:`profile`."""
    if lg is not None:
        return finished(states(cells, keys, lg), keys)
    # Cells are counted by a 64-bit hash of their text, so that what is shuffled is some numbers for each distinct value.
    values = _marked(cells, keys).groupBy(*keys, "blank", "h").agg(*_counted())
    return finished(values.groupBy(*keys).agg(*_merged(), F.count_if(~F.col("blank")).alias("n_distinct")), keys)


def profile(df: DataFrame, columns: list[str] | None = None, lg: int | None = None) -> DataFrame:
    """Counts, ratios, lengths, digits and inferred type of each column, read as text, in one pass.

    With ``lg``, distinct values are estimated by sketches of that size, see :func:`states`, and nothing but those is shuffled. Ratios are to all rows and rounded half to even at four places. A blank cell is null or white
    space. The texts NULL, null and Null are left out of inference only.
    """
    return profile_cells(as_text(df, columns), lg=lg)


def with_precision(profiled: DataFrame) -> DataFrame:
    """``precision``, ``scale`` as reported (largest of each apart), and ``fit_precision``, which holds every value."""
    decimal = F.col("data_type") == "DECIMAL"
    pick = lambda c: F.when(decimal, c)
    return profiled.withColumns({
        "precision": pick(F.col("max_digits")), "scale": pick(F.col("max_scale")), "fit_precision": pick(F.col("max_whole") + F.col("max_scale")),
    })
