import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


def brute(rows, k=5, step=50):
    usable = [(i, [min(max(math.floor(256 * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in dict(sorted(usable, key=lambda r: (r[0], r[1]), reverse=True)).items():
        if q % step == 0:
            found = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in usable if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(n=900, d=12, seed=1):
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(3, d))
    m = rng.normal(size=(n, 3)) @ turn + 0.05 * rng.normal(size=(n, d))
    m[:150] *= rng.uniform(0.01, 4, size=(150, 1))
    m[200:400] = m[200]  # ties
    return [(int(i), list(map(float, v))) for i, v in enumerate(m.astype(np.float32))]


@pytest.mark.parametrize(("candidates", "queries"), [(4096, 512), (64, 5)])
def test_matches_brute_force(spark, candidates, queries):
    rows = vectors() + [(2000, None), (2050, [1.0, None] * 6), (2100, [math.nan] + [0.0] * 11), (2150, [math.inf] * 12), (None, [1.0] * 12), (3, [9.0] * 12), (2200, [])]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, candidates=candidates, queries=queries)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_vectors_of_several_lengths_and_sizes(spark):
    rows = vectors(300) + [(1000 + i, v) for i, v in vectors(250, 3, 5)] + [(3000, [1.0]), (3050, [2.0]), (3001, [-4.0]), (50, [7.0, 7.0])]
    rows += [(4000 + i, [1e16 * (i - 20), 3e15, 1.0, 2.0]) for i in range(0, 60, 5)]  # products beyond 64 bits
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, candidates=64, queries=5)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_and_no_rows(spark):
    ask = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, topk.top_k(frame(spark, [(0, [1.0, 2.0]), (50, [1.0, 0.0])]), ask).collect())) == [(0, 1, 50, 65536), (50, 1, 0, 65536)]
    assert topk.top_k(frame(spark, []), ask).collect() == []
    assert topk.top_k(frame(spark, [(1, [1.0])]), ask).collect() == []
    assert topk.top_k(frame(spark, [(0, [0.0])]), ask).collect() == []


def test_sql_states_the_same():
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    rows = vectors(410)
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted(con.execute(topk.ORACLE_SQL).fetchall()) == brute(rows)


def test_one_length_is_dealt_to_slots(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCKS_A_SLOT", 3)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(600, 8))
    m /= np.sqrt((m**2).sum(axis=1))[:, None]
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(m.astype(np.float32))]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, candidates=32, queries=4)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_blocks_keep_integers_narrow():
    for top, width in ((2**15 - 1, 2), (2**15, 4), (2**31 - 1, 4), (2**31, 8), (2**63 - 1, 8)):
        for m in (np.array([[top, -1], [0, 3]], np.int64), np.array([[-top - 1, 5], [0, 3]], np.int64)):
            small = topk.narrowed(m)
            ids, back = topk._unpacked(np.arange(2, dtype=np.int64).tobytes(), small.tobytes(), 2)
            assert small.dtype.itemsize == width and back.dtype == np.int64 and (back == m).all() and list(ids) == [0, 1]
