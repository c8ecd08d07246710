"""Language identification in two steps: the family, then the language within it.

Letters are folded to lower case, all else among ASCII to spaces, and character n-grams of one to
four are hashed. A softmax-free linear machine per family (one against the rest) picks the family;
one-versus-one linear support vector machines of that family's languages then vote, by number of
duels won and then by summed margin. All are trained by averaged hinge-loss steps on a bounded
sample: about ``max_rows`` labelled documents a language, by hashed id.

Defined results: null text, or text without a letter, is ``und`` with score 0; a null doc_id is
never learnt from and not held out; with no labelled row every prediction is ``und``; repeated rows
each get a row; an empty table an empty result. Languages outside FAMILIES form families of one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, pieces, stage, table, values
from tessera.llm.quality import fold

# ISO 639-1 codes by branch.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
}
BITS = 17
ORDERS = (1, 2, 3, 4)
MAX_ROWS = 1_500
EPOCHS = 6
STREAM = 1_000_000  # code points of a text that are hashed at once
SCALE = 30.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint64)


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str):
    """Arrays of hashed character n-gram numbers of a text, with repeats; slices give the same as the whole."""
    text = text.lower()
    kept, gap_before = np.zeros(0, np.uint64), False
    for at in range(0, len(text), STREAM):
        part = text[at : at + STREAM]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        points = np.where(points < 128, _FOLD[np.minimum(points, 127)], points)
        gap = points == 32
        points = points[~(gap & np.concatenate([[gap_before], gap[:-1]]))]
        gap_before = bool(gap[-1])
        ends = [np.full(int(n), 32, np.uint64) for n in (at == 0, at + STREAM >= len(text))]
        padded = np.concatenate([kept, ends[0], points, ends[1]])
        gram, out = np.zeros(len(padded), np.uint64), []
        for order in range(1, ORDERS[-1] + 1):
            tail = padded[order - 1 :]
            gram = gram[: len(tail)] * np.uint64(1_000_003) + tail + np.uint64(order)
            fresh = gram[max(0, len(kept) - order + 1) :]  # those that end in what is new
            out.append((fresh * _MIX) >> np.uint64(64 - BITS))
        kept = padded[max(0, len(padded) - ORDERS[-1] + 1) :]
        yield np.concatenate(out).view(np.int64)


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(np.concatenate(list(features(text))), return_counts=True)
    return index.astype(np.int64), (count * (SCALE / count.sum())).astype(np.float32)


def hinge(rows, sides, epochs: int = EPOCHS, penalty: float = 1e-5) -> np.ndarray:
    """An averaged linear machine for sides of +1 and -1; the last entry is the bias.

    Both sides weigh the same in sum.
    """
    size = 1 << BITS
    w, total, steps = np.zeros(size + 1), np.zeros(size + 1), 0
    sides = np.asarray(sides)
    weight = {s: 0.5 * len(sides) / max(1, (sides == s).sum()) for s in (1, -1)}
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for at in order.permutation(len(rows)):
            index, value = rows[at]
            side = sides[at]
            if side * (w[index] @ value + w[size]) < 1:
                step = rate * weight[int(side)] * side
                w[index] += step * value
                w[size] += 0.1 * step
                total[index] += steps * step * value
                total[size] += 0.1 * steps * step
            steps += 1
        w *= 1 - penalty * len(rows)
        total *= 1 - penalty * len(rows)
    return (w - total / max(1, steps)).astype(np.float32)


def fit(texts: list[str], langs: list[str]) -> dict:
    """Names and one weight matrix: a column for each family, then one for each pair within one."""
    rows, langs = [_row(t) for t in texts], list(langs)
    names = sorted(set(langs))
    families = sorted({family_of(x) for x in names})
    columns, pairs = [], []
    for name in families:
        columns.append(hinge(rows, [1 if family_of(x) == name else -1 for x in langs]) if len(families) > 1 else np.zeros((1 << BITS) + 1, np.float32))
    for a, b in combinations(names, 2):
        if family_of(a) == family_of(b):
            at = [i for i, x in enumerate(langs) if x in (a, b)]
            columns.append(hinge([rows[i] for i in at], [1 if langs[i] == a else -1 for i in at]))
            pairs.append((a, b))
    return {"families": families, "members": {f: [x for x in names if family_of(x) == f] for f in families}, "pairs": pairs, "weights": np.stack(columns, axis=1)}


def _squash(z: float) -> float:
    return 1 / (1 + np.exp(-2 * min(max(z, -15.0), 15.0)))


def predict(model: dict | None, text: str | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return "und", 0.0
    weights = model["weights"]
    total, n = np.zeros(weights.shape[1]), 0
    for found in features(text):
        for at in range(0, len(found), 65536):
            total += weights[found[at : at + 65536]].sum(axis=0, dtype=np.float64)
        n += len(found)
    margin = total * (SCALE / n) + weights[-1]
    families = model["families"]
    best = int(np.argmax(margin[: len(families)]))
    share = np.array([_squash(m) for m in margin[: len(families)]])
    sure = float(share[best] / share.sum()) if len(families) > 1 else 1.0
    members = model["members"][families[best]]
    won, sums, chance = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
    for (a, b), m in zip(model["pairs"], margin[len(families) :], strict=True):
        if a in won:
            won[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            chance[a] *= _squash(m)
            chance[b] *= _squash(-m)
    lang = max(members, key=lambda x: (won[x], sums[x]))
    return lang, float(min(1.0, sure * chance[lang]))


def train(docs: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> dict | None:
    """A model learnt from about ``max_rows`` rows of each language that ``where`` admits."""
    known = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = (known.where(where) if where is not None else known).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    share = known.groupBy("l").agg((F.lit(float(max_rows)) / F.count(F.lit(1))).alias("share"))
    share = broadcast_if_small(stage(share, "language-share"))  # one row a language; else every text would be shuffled
    unit = F.pmod(F.xxhash64(F.lit(5), F.col("k")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.join(share, "l").where(unit < F.col("share")).select(F.col("k").cast("string").alias("k"), "l", "t")

    def run(pdf):
        import pickle

        import pandas as pd

        pdf = pdf[[has_letter(t) for t in pdf.t]]
        pdf = pdf.iloc[np.argsort([xxhash.xxh64_intdigest(f"{k} ") for k in pdf.k], kind="stable")]
        return pd.DataFrame({"model": [pickle.dumps(fit(list(pdf.t), list(pdf.l))) if len(pdf) else b""]})

    got = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").first()
    if got is None or not got.model:
        return None
    import pickle

    return pickle.loads(bytes(got.model))


def identify(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            made = [predict(shared.value, t) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                names=[key, "lang_pred", "score"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def op5_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, where=fold(F.col("doc_id"), 4) != 2)
    return identify(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
