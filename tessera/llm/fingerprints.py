"""Canonical exact fingerprints, by DataFrame functions alone.

A text's canonical form is NFKC, case-folded, NFKC again, with each run of white space as one
space and none at the ends. The fingerprint is the 128 bits of two differently seeded xxhash64 of
that form. Wherever documents share those bits, the canonical bytes of each are compared with those
of the bucket's representative; should a bucket hold unequal bytes, a prefix of the SHA-256 of the
canonical form is appended to the fingerprints in it. So fingerprints are equal exactly where
canonical texts are, and likeness is 1 or 0.

The next document, in descending order of doc_id, is found within ranges of doc_id: one shuffle
brings a range together, and the first text of the range that follows is added at its end.

Defined results: null text counts as empty; a null doc_id comes after all others; rows with one
doc_id follow each other by a hash of their text, then by text; the last document's next is the
first, so a lone document is its own next; texts of any length are read whole; an empty table gives an empty
result; other columns are ignored, whatever their names. Edited texts are fingerprinted as any other; their bytes
are compared where their bits are those of unequal originals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import broadcast_if_small, id_ranks, partitions, stage, table

MAX_RANGES = 4096  # cuts that a plan holds
ROWS = 20_000  # of a range


def canonical(text: Column) -> Column:
    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.btrim(F.regexp_replace(folded, r"[\s\x85\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    """Two independently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(canon).alias("a"), F.xxhash64(F.lit("wide"), canon).alias("b"))


def _hex(h: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{h}.a"), 16, "0"), F.lpad(F.hex(f"{h}.b"), 16, "0")))


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def collisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(h)``: wide hashes whose documents differ in canonical bytes. Normally empty."""
    rows = _plain(docs, key, text).withColumn("row", F.xxhash64("id", "text"))
    hashed = rows.select("row", wide_hash(canonical(F.col("text"))).alias("h"))
    shared = hashed.groupBy("h").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = broadcast_if_small(stage(shared.select("h", "first"), "fp-shared"))
    canon = rows.select("row", canonical(F.col("text")).alias("canon")).withColumn("h", wide_hash(F.col("canon")))
    members = stage(canon.join(shared, "h"), "fp-members")
    heads = members.where(F.col("row") == F.col("first")).groupBy("h").agg(F.min("canon").alias("head"))
    # Written before it is made distinct, so that a bucket of very many copies can be split over tasks.
    return stage(members.join(stage(heads, "fp-heads"), "h").where("canon != head").select("h"), "fp-differ").distinct()


def _place(rows: DataFrame, ranges: int) -> Column:
    """The range of each id, by descending id, nulls last: by quantiles, each cut into equal parts of about ``ROWS`` ids."""
    kind = rows.schema["id"].dataType
    found = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10_000), F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if found[1] is None:
        return F.lit(0)
    cuts = sorted(set(found[0]))[::-1]
    ident = F.col("id")
    wide = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    over = lambda a: F.size(F.filter(a, lambda c: c > ident))
    # How many cuts are over the id, in two looks at about the root of their number.
    group = over(F.array(*[F.lit(g[-1]) for g in groups]))
    inner = F.array(*[F.array(*map(F.lit, g)) for g in groups], F.array().cast(f"array<{kind.simpleString()}>"))
    place = F.least(group * wide + over(F.element_at(inner, group + 1)), F.lit(len(cuts)))
    parts = -(-found[3] // (ROWS * (len(cuts) + 1)))
    if parts > 1 and isinstance(kind, T.IntegralType):
        bounds = F.array(*map(F.lit, [found[2], *cuts, found[1] - 1]))
        high, low = F.element_at(bounds, place + 1), F.element_at(bounds, place + 2)
        place = place * parts + F.least(F.lit(parts - 1), F.floor((high - ident) * F.lit(float(parts)) / F.greatest(high - low, F.lit(1))).cast("int"))
    return F.when(ident.isNull(), F.lit((len(cuts) + 1) * parts)).otherwise(place).cast("int")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text, next)``: next is the text of the next document by descending key."""
    rows = _plain(docs, key, text)
    ranks = id_ranks(rows, "id", "rank")
    if ranks is not None:
        ranks = ranks.withColumnRenamed("id", "own")
        ranked = rows.join(ranks, F.col("id") == F.col("own"), "left").select("rank", "text")
        made = with_next(ranked, "rank", "text").withColumnRenamed("id", "at")
        return made.join(ranks, F.col("at") == F.col("rank"), "left").select(F.col("own").alias("id"), "text", "next")
    place = _place(rows, min(MAX_RANGES, 2 * partitions(docs.sparkSession)))
    firsts = stage(rows.groupBy(place.alias("of")).agg(F.max("id").alias("id")), "fp-firsts")
    # One row a range: its end is followed by the first document of the next, the last by the first of all.
    order = Window.orderBy("of")
    ends = firsts.select(F.lag("of").over(order).alias("place"), F.col("id").alias("first"))
    last = firsts.agg(F.max("of").alias("place"), F.max("id").alias("first"))
    ends = broadcast_if_small(stage(ends.where("place is not null").unionByName(last), "fp-ends"))
    added = rows.join(ends, F.col("id").eqNullSafe(F.col("first"))).select("place", F.lit(True).alias("added"), "id", "text")
    both = rows.select(place.alias("place"), F.lit(False).alias("added"), "id", "text").union(added)
    order = Window.partitionBy("place").orderBy("added", F.desc_nulls_last("id"), F.xxhash64("text"), "text")
    return both.withColumn("next", F.lead("text").over(order)).where(~F.col("added")).select("id", "text", "next")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint)`` of each document."""
    bad = stage(collisions(docs, key, text), "fp-bad").withColumn("bad", F.lit(True))
    rows = _plain(docs, key, text).select("id", canonical(F.col("text")).alias("canon"))
    rows = rows.select("id", wide_hash(F.col("canon")).alias("h"), F.substring(F.sha2("canon", 256), 1, 16).alias("more"))
    return rows.join(bad, "h", "left").select(
        F.col("id").alias(key), F.concat(_hex("h"), F.when(F.col("bad"), F.concat(F.lit("-"), "more")).otherwise("")).alias("fingerprint")
    )


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text has the last half of the code points replaced by the first as many of the next.
    """
    rows = with_next(docs, key, text).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *(canonical(F.col(c)).alias(c) for c in ("text", "edited", "next")),
    )
    rows = rows.select(
        "id", "n_chars", "edited_sha256", wide_hash(F.col("text")).alias("h"), wide_hash(F.col("edited")).alias("e"),
        F.substring(F.sha2("text", 256), 1, 16).alias("h_more"), F.substring(F.sha2("edited", 256), 1, 16).alias("e_more"),
        (F.col("text") == F.col("edited")).cast("double").alias("near_edited"), (F.col("text") == F.col("next")).cast("double").alias("near_next"),
    )
    bad = stage(collisions(docs, key, text), "fp-bad")
    for h in ("h", "e"):
        marked = bad.select(F.col("h").alias(h), F.lit("-").alias(f"{h}_bad"))
        rows = rows.join(marked, h, "left")
    return rows.select(
        F.col("id").alias(key), "n_chars", "edited_sha256",
        *(
            F.concat(_hex(h), F.when(F.col(f"{h}_bad").isNotNull(), F.concat(f"{h}_bad", f"{h}_more")).otherwise("")).alias(name)
            for h, name in (("h", "fingerprint"), ("e", "edited_fingerprint"))
        ),
        "near_edited", "near_next",
    )


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
