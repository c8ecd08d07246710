"""Mixing documents to target weights, by iterative proportional fitting; DataFrame functions alone.

Documents are counted into cells of source, language and topic, with partial sums before the
shuffle. Raking scales the cells' token weights to one marginal after the other until no marginal
is off by more than ``tolerance`` of its target, or ``rounds`` have passed. A cell's documents are
then drawn with one probability, such that the expected tokens of all cells are in proportion to
the raked weights and sum to ``share`` of all tokens; a cell that would need more than it has is
taken whole, and the rest is shared among the others.

Targets default to the marginals' own shares raised to ``power``, which lifts rare values. A draw
depends on the key and the seed alone, so it can be repeated on any cluster.

Defined results: null source, language or key counts as the value ``(none)``; null or empty text
has no tokens, and is drawn with its cell's probability (zero, if all its cell is empty); rows
that repeat a key are drawn alike; texts of any length are read whole; an empty table gives an empty result; other columns
are kept or ignored as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, stage, table, unstage

MARGINALS = ("source", "lang", "topic")
POWER, SHARE, ROUNDS, TOLERANCE, SEED = 0.5, 0.5, 40, 1e-9, "mix"
DECIMALS = 6

#: Topics, the first that matches: a name, a pattern, and texts of which one has to be there for it. A topic column may be given instead.
TOPICS = (
    ("licence", "(?i)license|rights reserved", ("license", "rights reserved")), ("contact", "[0-9A-Za-z]@[0-9A-Za-z]", ("@",)),
    ("list", r" \| ", (" | ",)), ("markup", "(&&&|%%%|###|!!)", ("&&&", "%%%", "###", "!!")),
)
SMALL = 200_000  # cells that one task works on
AT_ONCE = 4  # rounds in a job


def topic_of(text: Column, topics=TOPICS) -> Column:
    def fits(pattern: str, needed: tuple[str, ...]) -> Column:
        body = F.lower(text) if pattern.startswith("(?i)") else text
        there = reduce(lambda a, b: a | b, (body.contains(n) for n in needed))  # far cheaper than the pattern
        return there & text.rlike(pattern)

    cases = reduce(lambda c, t: c.when(fits(*t[1:]), t[0]), topics[1:], F.when(fits(*topics[0][1:]), topics[0][0]))
    return F.when(text.isNull(), "prose").otherwise(cases.otherwise("prose"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]++")), F.lit(0)).cast("long")


def own_targets(cells: DataFrame, power: float = POWER) -> dict[str, DataFrame]:
    """For each marginal ``(value, target)``, targets summing to 1."""
    made = {}
    for m in MARGINALS:
        raised = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raised")).where("raised > 0")
        total = raised.agg(F.sum("raised").alias("total"))
        # The total is one row.
        made[m] = raised.join(F.broadcast(total)).select(m, (F.col("raised") / F.col("total")).alias("target"))
    return made


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with a ``weight`` column whose marginals meet the targets; values without one get 0.

    Up to ``SMALL`` cells stay in one partition, where no step shuffles; more are shuffled by Spark for each step.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m, target in targets.items():
        now = now.join(target.select(m, F.col("target").alias(f"__{m}")), m, "left")
    now = stage(now, "mix")
    one = now.count() <= SMALL
    for _ in range(0, rounds, AT_ONCE):
        after = now.coalesce(1) if one else now
        for _ in range(AT_ONCE):
            for m in targets:
                after = after.withColumn("__total", F.sum("weight").over(Window.partitionBy(m)))
                scale = F.when(F.col("__total") > 0, F.coalesce(f"__{m}", F.lit(0.0)) / F.col("__total")).otherwise(0.0)
                after = after.withColumn(f"__off_{m}", F.when(F.col("weight") > 0, F.abs(scale - 1))).withColumn("weight", F.col("weight") * scale).drop("__total")
        after = stage(after, "mix")
        worst = after.agg(F.max(F.array_max(F.array(*(F.col(f"__off_{m}") for m in targets))))).first()[0]
        unstage(now)
        now = after.drop(*(f"__off_{m}" for m in targets))
        now._staged_path = after._staged_path
        if (worst or 0.0) <= tolerance:
            break
    out = now.select(*cells.columns, "weight")
    out._staged_path = now._staged_path
    return out


def calibrate(weighted: DataFrame, share: float = SHARE) -> DataFrame:
    """``weighted`` with the ``probability`` of each cell's documents."""
    tokens = F.col("tokens").cast("double")
    budget = share * (weighted.agg(F.sum(tokens)).first()[0] or 0.0)
    scale = 0.0
    while True:
        whole = (F.col("weight") * F.lit(scale) >= tokens) & (F.col("weight") > 0)
        taken, rest = weighted.agg(F.sum(F.when(whole, tokens)), F.sum(F.when(~whole, F.col("weight")))).first()
        if not rest or (taken or 0.0) >= budget:
            break
        new = (budget - (taken or 0.0)) / rest
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return weighted.withColumn("probability", F.when(tokens > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / tokens)).otherwise(0.0))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that is fixed by the key and the seed."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "-"), F.coalesce(key.cast("string"), F.lit("(none)")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = POWER, share: float = SHARE,
        rounds: int = ROUNDS, seed: str = SEED, key: str = "doc_id", text: str = "text", keep: bool = False, topic: str | None = None) -> DataFrame:
    """For each document its cell, tokens, the cell's weight and probability, and ``sampled``.

    ``topic`` names a column of topics; without it they come from ``TOPICS``. With ``keep``, the sampled rows of ``docs`` themselves.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(f"__{c}") for c in ("source", "lang")]
    about = F.coalesce(F.col(topic).cast("string"), F.lit("(none)")) if topic else topic_of(F.col(text))
    # Other columns travel in a struct, so that none clashes with what is added.
    own = [F.struct("*").alias("__doc"), F.col(key).alias("__key")] if keep else [F.col(key)]
    rows = docs.select(*own, *named, about.alias("__topic"), token_count(F.col(text)).alias("__tokens"))
    if not keep:
        rows = stage(rows, "mix-rows")  # a few short columns, so that texts are read once
    cells = rows.groupBy(*(F.col(f"__{m}").alias(m) for m in MARGINALS)).agg(F.sum("__tokens").alias("tokens"))
    cells = stage(cells, "mix-cells")
    weighted = rake(cells, targets or own_targets(cells, power), rounds)
    chances = stage(calibrate(weighted, share).select(*(F.col(m).alias(f"__{m}") for m in MARGINALS), "weight", "probability"), "mix-chances")
    unstage(cells, weighted)
    chances = broadcast_if_small(chances)
    if keep:
        chances = chances.withColumnsRenamed({"weight": "__weight", "probability": "__probability"})
        joined = rows.join(chances, [f"__{m}" for m in MARGINALS])
        return joined.where(draw(F.col("__key"), seed) < F.col("__probability")).select("__doc.*")
    joined = rows.join(chances, [f"__{m}" for m in MARGINALS])
    return joined.select(
        key, *(F.col(f"__{m}").alias(m) for m in MARGINALS), F.col("__tokens").alias("tokens"),
        F.round("weight", DECIMALS).alias("weight"), F.round("probability", DECIMALS).alias("probability"),
        (draw(F.col(key), seed) < F.col("probability")).alias("sampled"),
    )


def op10_mix_raked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql(rounds: int = 30, fills: int = 12) -> str:
    """The same in SQL, with the rounds written out; rounds beyond convergence change nothing."""
    when = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p, _ in TOPICS)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CASE {when} ELSE 'prose' END AS topic,
  CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^ \\t\\n\\x0B\\f\\r]+', chr(1), 'g'), '[^' || chr(1) || ']', '', 'g')), 0) AS BIGINT) AS tokens FROM documents)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
    ]
    for m in MARGINALS:
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS target FROM c GROUP BY {m})")
    steps.append("w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM c)")
    last = "w0"
    for i in range(rounds):
        for m in MARGINALS:
            name = f"w_{i}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT w.* REPLACE (w.weight * coalesce(t.target / nullif(sum(w.weight) OVER (PARTITION BY w.{m}), 0), 0) AS weight) FROM {last} w JOIN t_{m} t USING ({m}))")
            last = name
    steps.append("s0 AS (SELECT CAST(0 AS DOUBLE) AS scale)")
    for i in range(fills):
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT coalesce(({SHARE} * sum(tokens) - coalesce(sum(tokens) FILTER (weight * scale >= tokens), 0))
  / sum(weight) FILTER (weight * scale < tokens), any_value(scale)) AS scale FROM {last}, s{i})""")
    return f"""WITH {', '.join(steps)}, p AS (SELECT source, lang, topic, weight, CASE WHEN tokens > 0 THEN least(1, weight * scale / tokens) ELSE 0 END AS probability FROM {last}, s{fills})
SELECT doc_id, source, lang, topic, d.tokens, round(weight, {DECIMALS}) AS weight, round(probability, {DECIMALS}) AS probability,
  CAST('0x' || substr(md5('{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '(none)')), 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE) < probability AS sampled
FROM d JOIN p USING (source, lang, topic)"""


ORACLE_SQL = _sql()
