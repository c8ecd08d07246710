import hashlib
import random

import pytest

import corpus_pipeline
from tessera.llm import mixing, quality
from tests.llm import test_near_texts as near_texts
from tests.llm import test_passages as passages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_columns_and_subsets(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns == stages[0].columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}


def test_each_stage_against_its_input(spark, stages):
    texts = [{r.doc_id: r for r in s.collect()} for s in stages]
    model = quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), where=quality.fold(corpus_pipeline.F.col("doc_id"), 3) != 1)
    assert set(texts[1]) == {i for i, r in texts[0].items() if quality.logistic(quality.raw_score(*model, r.text)) >= 0.5}
    rows = sorted((r.doc_id, r.text) for r in texts[1].values())
    assert sorted(texts[2]) == [key for _, key in near_texts.brute(rows)] and len(texts[2]) < len(texts[1])
    rows = sorted((r.doc_id, r.text) for r in texts[2].values())
    assert [(i, texts[3][i].text.split()) for i in sorted(texts[3])] == [(i, [str(w) for w in words]) for i, words in passages.brute(rows, corpus_pipeline.PASSAGE_WORDS)]
    assert all(r.n_chars == len(r.text) for r in texts[3].values())
    drawn = {r.doc_id for r in mixing.mix(stages[3]).where("sampled").collect()}
    assert set(texts[4]) == drawn and 0 < len(drawn) < len(texts[3])
    for i, r in texts[5].items():
        assert r.decoded_sha256 == hashlib.sha256(texts[4][i].text.encode()).hexdigest() and len(r.ids) == r.n_tokens
    assert set(texts[5]) == set(texts[4])


def test_odd_rows_go_through(spark):
    rng = random.Random(0)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, " ".join(rng.choices(["the", "and", "of", "to"], k=30)), "en", "a", 1) for i in range(20)]
    rows += [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)]
    rows += [(30, "the house and " * 40_000, "en", "a", 1), (31, "the house of " * 40_000, "en", None, 1)]
    more = ", __row string, row string, h string, c string, bucket string, component string, weight double, __topic string, pair long"
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", 1.0, "x", 1) for r in rows], schema + more)
    for name, function in corpus_pipeline.STAGES:
        after = function(spark, docs, SF)
        assert name == "tokens" or after.columns == docs.columns
        docs = corpus_pipeline.stage(after, f"odd-{name}")
    docs.collect()
    docs = spark.createDataFrame([], schema)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF)
    assert docs.collect() == []
