import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, weight string, topic string"


def rows(n=400):
    for i in range(n):
        words = "word " * (1 + i * 7 % 40) + ("see a@b " if i % 5 == 0 else "") + ("x | y" if i % 7 == 0 else "")
        yield (i, words, ["en", "de", "fr", None][i % 11 % 4], "hot" if i % 3 == 0 else f"s{i % 4}", 1, "w", "t")
    yield from [(None, "no key here", "en", "hot", 1, "w", "t"), (5, None, None, None, None, None, None), (6, "", "en", "s1", 0, "", ""), (6, "", "en", "s1", 0, "", "")]


def test_matches_sql(spark):
    docs = spark.createDataFrame(list(rows()), SCHEMA)
    got = mixing.mix(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().assign(doc_id=lambda d: d.doc_id.astype("Int64")))
    want = con.execute(f"select {', '.join(got.columns)} from ({mixing.ORACLE_SQL})").fetchall()
    key = lambda r: (str(r[0]), *map(str, r[1:5]))
    mine, theirs = sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)
    assert len(mine) == len(theirs) == 404
    for a, b in zip(mine, theirs, strict=True):
        assert a[:5] == b[:5] and a[7] == b[7] and a[5:7] == pytest.approx(b[5:7], abs=2e-6)


def test_marginals_meet_targets(spark):
    docs = spark.createDataFrame(list(rows()), SCHEMA)
    out = mixing.mix(docs).toPandas()
    cells = out.drop_duplicates(["source", "lang", "topic"])
    for m in mixing.MARGINALS:
        share = out.groupby(m).tokens.sum().pow(0.5)
        share /= share.sum()
        assert cells.groupby(m).weight.sum().to_dict() == pytest.approx(share[share > 0].to_dict() | dict.fromkeys(share[share == 0].index, 0), abs=1e-4)
    assert (out.tokens * out.probability).sum() == pytest.approx(out.tokens.sum() / 2, rel=1e-3)


def test_given_targets_and_keep(spark):
    docs = spark.createDataFrame(list(rows()), SCHEMA)
    targets = {"source": spark.createDataFrame([("hot", 0.5), ("s1", 0.5)], "source string, target double")}
    out = mixing.mix(docs, targets)
    assert {r.source for r in out.where("weight > 0").collect()} == {"hot", "s1"}
    kept = mixing.mix(docs, targets, keep=True)
    assert kept.columns == docs.columns and kept.count() == out.where("sampled").count() > 0


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA)).select(F.col("sampled")).collect()[0][0] is False
