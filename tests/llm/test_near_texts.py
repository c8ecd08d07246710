import random

import numpy as np

import corpus_pipeline
from tessera.llm import simhash

SCHEMA = "doc_id long, text string, __clash string"


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, group = [plain(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                group[root(i)] = root(j)
    kept = {}
    for i, (key, _) in enumerate(rows):
        kept.setdefault(root(i), []).append((key is None, key or 0))
    return sorted(min(x) for x in kept.values())


def texts():
    rng = random.Random(4)
    say = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]
    rows = []
    for n in (12, 25, 40, 60, 120, 400):
        for _ in range(4):
            base = say(n)
            rows.append(base)
            for changes in range(1, max(2, n // 22)):  # on both sides of 0.8
                near = list(base)
                for at in rng.sample(range(n), changes):
                    near[at] = "changed"
                rows.append(near)
    chain = say(200)
    for i in range(6):
        rows.append(chain[i * 8 : i * 8 + 150])
    rows = [" ".join(r) for r in rows]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    return rows + [(900, rows[0][1].upper()), (3, rows[3][1]), (3, rows[3][1]), (901, None), (902, " "), (None, rows[5][1]), (None, "only here"), (903, "One two")]


def run(spark, rows, **more):
    kept = simhash.keep_one(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), **more)
    assert kept.columns == ["doc_id", "text", "__clash"]
    return sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())


def test_matches_brute_force(spark):
    rows = texts()
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_chunks_lose_no_link(spark):
    rows = texts()
    assert run(spark, rows, most=300) == brute(rows)


def test_keys_and_limit_find_pairs_at_the_limit():
    """At a similarity of exactly 0.8, by the plan for five sizes."""
    rng = np.random.default_rng(5)
    p = simhash.differing(0.8)
    apart = []
    for _ in range(2000):
        both = np.unique(rng.integers(0, 2**64, 100, np.uint64))
        a, b = (simhash.wide_fingerprint(x) for x in (both[:90], both[10:]))
        apart.append((np.unpackbits((a ^ b).view(np.uint8)).sum(), np.bitwise_count(a ^ b)[:2].sum()))
    apart = np.array(apart)
    assert abs(apart[:, 0].mean() / 256 - p) < 0.01
    assert (apart[:, 1] > np.ceil(128 * p + 4 * np.sqrt(128 * p * (1 - p)))).mean() < 0.002
    for n in (100, 50_000, 10**6, 10**8, 10**10):
        bits, keys = simhash.key_plan(n)
        met = np.prod([(256 - apart[:, 0] - i) / (256 - i) for i in range(bits)], axis=0)
        assert ((1 - met) ** keys).mean() < 0.015, n


def test_stage_drops_near_copies_at_a_similarity_of_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]
    near = [*words[:30], "x", *words[31:70], "y", *words[71:]]
    far = [*words[:30], "x", *words[31:50], "y", *words[51:70], "z", *words[71:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far[::-1])), (4, " ".join(words[::-1]))], "doc_id long, text string")
    assert 0.8 <= len(plain(docs.collect()[0].text) & plain(" ".join(near))) / len(plain(" ".join(words)) | plain(" ".join(near))) < 0.83
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4}
