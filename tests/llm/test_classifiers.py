import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import language, quality

SCHEMA = "doc_id long, text string, lang string, score double, quality int"
WORDS = {"en": "the and of thing with for that house", "de": "der die und ein mit für haus schön", "fr": "le les de et une avec été très", "es": "el los que y una con años muy"}


def text(rng, lang, bad=False):
    words = rng.choices(WORDS[lang].split(), k=rng.randint(15, 60))
    return " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."


def rows(n=400):
    rng = random.Random(4)
    for i in range(n):
        lang = list(WORDS)[i % 4]
        yield (i, text(rng, lang, i % 5 == 0), lang, 1.0, int(i % 5 != 0))


def folds(i, n):
    return zlib.crc32(str(i).encode()) % n


def tables(spark):
    more = [(1000, None, "en", None, None), (1001, "", "en", None, None), (1002, "12 34 ...", None, None, None), (None, "der haus und die", None, None, None), (3, "repeated row", "en", None, None), (1003, "the house " * 90_000, None, None, None)]
    docs = spark.createDataFrame([*rows(), *more], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows()] + [(0, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = tables(spark)
    model = quality.train(docs, labels, where=quality.fold(F.col("doc_id"), 3) != 1)
    out = quality.score(docs, model).collect()
    assert len(out) == docs.count()
    want = {r[0]: r[4] for r in rows()}
    held = [(r.score >= 0.5) == want[r.doc_id] for r in out if r.doc_id in want and r.doc_id != 3 and folds(r.doc_id, 3) == 1]
    assert np.mean(held) > 0.97 and len(held) > 100
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (1000, 1001)} == {float(quality.logistic(model[1]))}
    kept = quality.score(docs, model, passing=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in out)


def test_quality_without_labels_or_rows(spark):
    docs, labels = tables(spark)
    model = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(5), model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def test_quality_training_is_bounded_and_ftrl_is_sparse(spark):
    weights, _ = quality.ftrl([r[1] for r in rows(40)], [r[4] for r in rows(40)])
    assert 0 < (weights != 0).sum() < 4000
    whole = list(quality.features("a b c " * 1000))
    quality.STREAM, old = 500, quality.STREAM
    try:
        cut = list(quality.features("a b c " * 1000))
    finally:
        quality.STREAM = old
    assert len(cut) > 1 and sorted(np.concatenate(cut)) == sorted(np.concatenate(whole))


def test_language(spark):
    docs, _ = tables(spark)
    model = language.train(docs, where=quality.fold(F.col("doc_id"), 4) != 2)
    out = language.identify(docs, model).collect()
    want = {r[0]: r[2] for r in rows()}
    held = [r.lang_pred == want[r.doc_id] for r in out if r.doc_id in want and r.doc_id != 3 and folds(r.doc_id, 4) == 2]
    assert np.mean(held) > 0.97 and len(held) > 80
    by = {r.doc_id: r for r in out}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[None].lang_pred == "de" and by[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out)
    assert language.identify(docs.limit(0), model).collect() == []


def test_language_without_training_rows(spark):
    docs, _ = tables(spark)
    assert language.train(docs.where("lang is null")) is None
    assert {r.lang_pred for r in language.identify(docs.limit(3), None).collect()} == {"und"}


@pytest.mark.parametrize("langs", [["en"], ["en", "fr"], ["en", "de"], ["xx", "en", "de", "fr", "es", "yy"]])
def test_any_set_of_languages(langs):
    rng = random.Random(1)
    texts = [(text(rng, lang) if lang in WORDS else f"{lang}aa {lang}bb " * 9, lang) for lang in langs for _ in range(20)]
    model = language.fit(*zip(*texts, strict=True))
    assert all(language.predict(model, t)[0] == lang for t, lang in texts)


def plain_language_features(text):
    """Numbers of character n-grams, as the docstring states them, one at a time."""
    kept, gap = [], False
    for c in text.lower():
        c = " " if ord(c) < 128 and not c.isalpha() else c
        if not (c == " " and gap):
            kept.append(ord(c))
        gap = c == " "
    points, out, full = [32, *kept, 32], {}, 2**64 - 1
    for n in range(1, 5):
        for at in range(len(points) - n + 1):
            gram = 0
            for order, p in enumerate(points[at : at + n], 1):
                gram = (gram * 1_000_003 + p + order) & full
            number = (gram * 0x9E3779B97F4A7C15 & full) >> 64 - language.BITS
            out[number] = out.get(number, 0) + 1
    return out


def counted(parts):
    out = {}
    for x in np.concatenate(list(parts)).tolist():
        out[x] = out.get(x, 0) + 1
    return out


@pytest.mark.parametrize("stream", [1, 2, 7, 1_000_000])
def test_language_features_match_plain_ones_at_any_slice(stream, monkeypatch):
    monkeypatch.setattr(language, "STREAM", stream)
    for t in ("a", "  ", "Der  Häuser-12 ,, fährt\n\n", "x" * 9, "été 7 où", " lead and trail  "):
        assert counted(language.features(t)) == plain_language_features(t), t


def plain_machine(rows, sides, epochs):
    """The average over all steps of a linear machine's weights, by plain dictionaries."""
    w, total, steps = {}, {}, 0
    weight = {s: 0.5 * len(sides) / max(1, sides.count(s)) for s in (1, -1)}
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        for at in order.permutation(len(rows)):
            row, side = rows[at], sides[at]
            if side * (sum(w.get(i, 0.0) * v for i, v in row.items()) + w.get("bias", 0.0)) < 1:
                step = 0.5 / (1 + epoch) * weight[side] * side
                for i, v in [*row.items(), ("bias", 0.1)]:
                    w[i] = w.get(i, 0.0) + step * v
                    total[i] = total.get(i, 0.0) + steps * step * v
            steps += 1
        shrink = 1 - 1e-5 * len(rows)
        w, total = ({i: v * shrink for i, v in x.items()} for x in (w, total))
    return {i: v - total.get(i, 0.0) / steps for i, v in w.items()}


def test_linear_machine_matches_plain_one():
    texts = [r[1] for r in rows(40)]
    sides = [1 if r[2] in ("en", "de") else -1 for r in rows(40)]
    made = [{i: n * language.SCALE / sum(f.values()) for i, n in f.items()} for f in map(plain_language_features, texts)]
    want = plain_machine(made, sides, 3)
    got = language.hinge([language._row(t) for t in texts], sides, epochs=3)
    bias = want.pop("bias", 0.0)
    assert abs(got[-1] - bias) < 1e-4 and set(np.flatnonzero(got[:-1])) <= set(want)
    assert max(abs(got[i] - v) for i, v in want.items()) < 1e-3 * max(map(abs, want.values()))


def plain_quality_features(text):
    tokens = quality._TOKEN.findall(text)
    word = [xxhash.xxh64_intdigest(t.lower().encode()) >> 3 << 3 >> 3 for t in tokens]
    shape = [4 if not (t[0].isalnum() or t[0] == "_") else 3 if t.isdigit() else 2 if len(t) > 1 and t.isupper() else int(t[0].isupper()) for t in tokens]
    raw = list(word) + [1 if a == b else a * 31 + b for a, b in zip(word, word[1:], strict=False)] + [a * 8 + b + 1000 for a, b in zip(shape, shape[1:], strict=False)]
    out = {}
    for x in raw:
        number = (x * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 64 - quality.BITS
        out[number] = out.get(number, 0) + 1
    return out


def plain_ftrl(texts, labels, epochs, alpha=0.2, beta=1.0, l1=0.02, l2=0.5):
    z, n = {}, {}

    def w(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    rows = []
    for t in texts:
        f = plain_quality_features(t)
        rows.append({i: c / max(1, sum(f.values())) ** 0.5 for i, c in f.items()} | {"bias": 1.0})
    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            now = {i: w(i) for i in row}
            p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in row.items())))
            for i, v in row.items():
                g = (p - y) * v
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * now[i]
                n[i] = old + g * g
    return {i: w(i) for i in z}


def test_quality_matches_plain_ftrl():
    texts, labels = [r[1] for r in rows(40)], [r[4] for r in rows(40)]
    for t in texts[:5]:
        assert counted(quality.features(t)) == plain_quality_features(t)
    want = plain_ftrl(texts, labels, 3)
    got, bias = quality.ftrl(texts, labels, epochs=3)
    assert abs(bias - want.pop("bias")) < 1e-4 and max(abs(got[i] - v) for i, v in want.items()) < 1e-4
    f = plain_quality_features(texts[0])
    assert abs(quality.raw_score(got, bias, texts[0]) - bias - sum(got[i] * c for i, c in f.items()) / sum(f.values()) ** 0.5) < 1e-3
