"""Quality classifier: hashed word n-gram logistic regression with FTRL-proximal updates.

Words, punctuation runs and their shapes are hashed as unigrams and bigrams; a bigram of two equal
words is one feature whatever the word. A score is the logistic function of a sparse dot product,
divided by the root of the number of n-grams. Training reads at most ``max_rows`` labelled
documents (those of smallest hashed id), in one task; the model has a fixed size.

Defined results: null text counts as empty, which scores by the bias alone; a null doc_id has no
label and is not held out; a doc_id labelled more than once has the mean label, rounded; with no
usable label every score is 0.5; repeated rows each get a row; an empty table an empty result.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hold, let_go, pieces, release, stage, table, values

BITS = 18
MAX_ROWS = 12_000
EPOCHS = 3
STREAM = 500_000  # tokens of a text that are hashed at once

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


class _Words(dict):
    """token -> hash << 3 | shape; bounded, since old entries are dropped all at once."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        shape = 4 if not (token[0].isalnum() or token[0] == "_") else 3 if token.isdigit() else 2 if len(token) > 1 and token.isupper() else 1 if token[0].isupper() else 0
        got = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass")) >> 3 << 3 | shape
        if len(token) <= 64:
            self[token] = got
        return got


_words = _Words()


def features(text: str):
    """Arrays of hashed feature numbers of a text, with repeats."""
    before = np.zeros(0, np.uint64)
    tokens = (m.group() for m in _TOKEN.finditer(text))
    whole = _TOKEN.findall(text) if len(text) <= STREAM else None
    while run := whole if whole is not None else list(islice(tokens, STREAM)):
        coded = np.concatenate([before, np.fromiter(map(_words.__getitem__, run), np.uint64, len(run))])
        word, shape = coded >> np.uint64(3), coded & np.uint64(7)
        fresh = word[len(before) :]
        pair = word[:-1] * np.uint64(31) + word[1:]
        pair[word[:-1] == word[1:]] = 1
        shapes = shape[:-1] * np.uint64(8) + shape[1:] + np.uint64(1000)
        yield ((np.concatenate([fresh, pair, shapes]) * _MIX) >> _SHIFT).view(np.int64)
        before, whole = coded[-1:], None if whole is None else []


def raw_score(weights: np.ndarray, bias: float, text: str | None) -> float:
    total, n = 0.0, 0
    for found in features(text or ""):
        total += float(weights[found].sum(dtype=np.float64))
        n += len(found)
    return bias + (total / n**0.5 if n else 0.0)


def logistic(z: float) -> float:
    return 1 / (1 + np.exp(-min(max(z, -35.0), 35.0)))


def ftrl(texts: list[str], labels: list[int], epochs: int = EPOCHS, alpha=0.2, beta=1.0, l1=0.02, l2=0.5):
    """Weights and bias after passes of per-coordinate FTRL-proximal updates in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for text, y in zip(texts, labels, strict=True):
        parts = list(features(text or ""))
        index, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
        rows.append((np.append(index.astype(np.int32), size), count.astype(np.min_scalar_type(count.max(initial=0))), max(1, count.sum()) ** 0.5, y))

    def solve(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for index, count, norm, y in rows:
            value = np.append(count / norm, 1.0).astype(np.float32)
            zi, ni = z[index], n[index]
            w = solve(zi, ni)
            g = (logistic(float(w @ value)) - y) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
    w = solve(z, n)
    return w[:size].astype(np.float32), float(w[size])


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality",
          key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from at most ``max_rows`` labelled rows that ``where`` admits."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.where(where) if where is not None else known
    known = known.groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("__label"))
    known = stage(known.orderBy(F.xxhash64(key), key).limit(max_rows), "quality-known")
    rows = docs.select(key, text).join(known, key).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col("__label").alias("y"))
    rows = rows.dropDuplicates(["k"])

    def fit(pdf):
        import pandas as pd

        let_go()
        pdf = pdf.iloc[np.argsort([xxhash.xxh64_intdigest(k) for k in pdf.k], kind="stable")]
        weights, bias = ftrl(list(pdf.t), list(pdf.y))
        release()
        return pd.DataFrame({"w": [weights.tobytes()], "b": [bias]})

    got = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "w binary, b double").first()
    if got is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(got.w, np.float32), got.b


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", passing: bool = False) -> DataFrame:
    """``(key, score)`` of each whole text; with ``passing``, the rows themselves that score 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(column):
        hold("quality", _words.clear)
        return np.array([logistic(raw_score(*shared.value, t)) for t in values(column)])

    if passing:
        at = docs.columns.index(text)

        def run(batches):
            for batch in pieces(batches, keep="quality"):
                yield batch.filter(pa.array(scores(batch.column(at)) >= 0.5))

        return docs.mapInArrow(run, docs.schema)

    def run(batches):
        for batch in pieces(batches, keep="quality"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)), pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), where=fold(F.col("doc_id"), 3) != 1)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
