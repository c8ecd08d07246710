import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(rows):
    fps = {i: simhash.fingerprint(t) for i, (_, t) in enumerate(rows)}
    group = {i: i for i in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                group[root(j)] = root(i)
    least = {}
    for i in fps:
        key = rows[i][0]
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted((str(rows[i][0]), format(fps[i], "x"), str(least.get(root(i)))) for i in fps)


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_as_stated():
    for text in ("", " \n", "One", "A b", "É b\x85c d", "the cat sat on the mat " * 40, "x\x1fy z\x0bw q"):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text
    assert simhash.fingerprint(None) == 0


def codes(n, rng, flips=2):
    """Fingerprints near six centres, and others apart."""
    made = rng.integers(0, 2**64, (6, 2), np.uint64)[rng.integers(0, 6, n)]
    for _ in range(flips):
        made[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.concatenate([made, rng.integers(0, 2**64, (n // 3, 2), np.uint64)])


@pytest.mark.parametrize("frontier", [1 << 18, 100])
@pytest.mark.parametrize("limit", [3, 40])
def test_forest_matches_brute_force(limit, frontier, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(1)
    fps = codes(900, rng)
    buckets = rng.choice([1, 1, 1, 1, 5, 6, 7, 8, 9], len(fps)) + 10 * (rng.random(len(fps)) < 0.01)
    child, root = simhash.forest(buckets, fps, limit)
    got, want = (simhash._merge(np.arange(len(fps)), x, y) for x, y in ((child, root), (root, child)))
    assert (got == want).all()
    a, b = np.triu_indices(len(fps), 1)
    near = (buckets[a] == buckets[b]) & (np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= limit)
    assert (got == simhash._merge(np.arange(len(fps)), a[near], b[near])).all() and near.sum() > 500


def test_index_prunes_groups_and_visits_each_small_bucket():
    rng = np.random.default_rng(2)
    index = simhash.GrayIndex(np.repeat(np.arange(40), 2), np.repeat(rng.integers(0, 2**64, (40, 1), np.uint64), 2, axis=0))
    assert len(index.starts) == 2 and len(index.patterns[1]) == 40  # even buckets of two have a node of their own
    seen = []
    index = simhash.GrayIndex(np.zeros(4096, np.int64), codes(3072, rng))
    index.linked(np.arange(4096), 3, lambda level, q, n: seen.append(len(q)) or np.zeros(len(q), bool))
    assert len(seen) == len(index.starts) and seen[-1] < 4096 * 4095 / 4


def texts():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(20, 300))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        t = rng.choice(base).split(" ")
        t[rng.randrange(len(t))] = "changed"
        rows.append((100 + i, " ".join(t)))
    rows += [(200 + i, base[0]) for i in range(30)]
    return rows + [(7, base[3]), (300, None), (301, ""), (None, base[1]), (302, "one two"), (None, "only here " * 9)]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    out = simhash.near_duplicates(docs).collect()
    return sorted((str(r.doc_id), format(r.fp % 2**64, "x"), str(r.component_id)) for r in out)


def test_components_match_brute_force(spark):
    rows = texts()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bucket", [3, 20])
def test_hot_buckets_in_chunks_lose_no_link(spark, bucket):
    fps = sorted({simhash.fingerprint(t) for _, t in texts()})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    whole = simhash.connected_components(simhash.link_fingerprints(df)).collect()
    cut = simhash.connected_components(simhash.link_fingerprints(df, bucket=bucket)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and whole


def test_empty_table(spark):
    assert run(spark, []) == []


def test_links_of_the_query_come_from_the_index(spark, monkeypatch):
    """Without the index there is no link but between equal fingerprints."""
    monkeypatch.setattr(simhash, "gray_links", lambda *_: lambda dealt: dealt.selectExpr("fp a", "fp b").where("a != b"))
    rows = texts()
    assert len({c for _, _, c in run(spark, rows)}) == len({f for _, f, _ in brute(rows)}) > len({c for _, _, c in brute(rows)})
