import random
import re
from bisect import bisect_right
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, range int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "x", 0, 0) for i, (t, la) in enumerate(rows)], SCHEMA)


def grams(rows):
    found = {}
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            own = found.setdefault(lang or "und", Counter())
            for m in range(1, 5):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return found


def brute(rows, least=30, top=2000, share=80):
    out = []
    for lang, f in grams(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        frequent = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in frequent.items():
            inside = any(len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in frequent.items())
            if not inside:
                score, _, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts(n=160, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "é", "日本", "a", "b", "\x00", "x\x1cy", "THE"]
    out = [(" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60))).replace("a b", "a b" + rng.choice([".", ", ", " ", "\t", "\n"])), rng.choice(["en", "en", "de", None])) for _ in range(n)]
    return out + [("machine learning is fun " * 40, "fr"), (None, "en"), ("", None), ("one two", "xx"), ("one two", "xx")]


def test_equals_counting(spark):
    rows = texts()
    got = [tuple(r) for r in C.collocations(frame(spark, rows), least=5, top=40).collect()]
    assert sorted(got) == brute(rows, 5, 40) and got


def test_many_ranges_slots_and_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_BYTES", 700)
    monkeypatch.setattr(C, "MAX_CUTS", 9)
    monkeypatch.setattr(C, "WORDS_A_KEY", 3)
    monkeypatch.setattr(C, "LOOKUPS", 20)
    rows = texts(60, 4)
    got = [tuple(r) for r in C.collocations(frame(spark, rows), least=4, share=60).collect()]
    assert sorted(got) == brute(rows, 4, share=60) and got


def test_nothing(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [(None, None), ("one", "en")]), least=1).collect() == []


def test_sql_states_the_same():
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar)")
    rows = [r for r in texts(400) if "\x00" not in (r[0] or "")]
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(C.ORACLE_SQL).fetchall()) == brute(rows)


def shard(rows, lang="en"):
    found = [w for text, _ in rows for w in [*C.tokens(text), C.BREAK]]
    words = sorted(set(found) - {C.BREAK})
    return C.counted(np.array([0 if w == C.BREAK else words.index(w) + 1 for w in found], np.int64), len(words) + 1), words


def spelled(row):
    own, out, texts = C.Automaton(row), {}, [()]
    for parent, label, weight in own.levels():
        texts = [texts[p] + (own.words[x],) for p, x in zip(parent, label, strict=True)]
        out |= {t: int(w) for t, w in zip(texts, weight, strict=True) if w}
    return out


@pytest.mark.parametrize("slots", [1, 3])
def test_parts_hold_every_count_once_and_their_union_adds_up(slots, monkeypatch):
    monkeypatch.setattr(C, "UNITE", 50)
    halves = [[(t, "en") for t, _ in texts(50, seed)] for seed in (1, 2)]
    want = Counter({tuple(w.encode() for w in g): c for g, c in grams(halves[0] + halves[1])["en"].items()})
    ranges = C.Ranges([], 1)
    ranges.slots = slots
    ranges.cuts, ranges.first = {"en": sorted(random.Random(3).sample(sorted(want), 25))}, {"en": 0}
    unions, arcs = {}, 0
    for half in halves:
        levels, words = shard(half)
        for at, part in ranges.parts("en", levels, words):
            row = dict(zip(C.COLUMNS, C._row(at, "en", part, words, 1), strict=True))
            arcs += len(C.Automaton(row).labels)
            for g in spelled(row):  # each n-gram is where look-ups go
                assert ranges.of("en", list(g)) == at and bisect_right(ranges.cuts["en"], g) == at // slots
            unions.setdefault(at, C._Union()).add(row)
    got = Counter()
    for at, union in unions.items():
        levels, words, _ = union.frequent(3)
        row = dict(zip(C.COLUMNS, C._row(at, "en", levels, words, 0), strict=True))
        own = C.Automaton(row)
        for g, c in spelled(row).items():
            assert own.weight(list(g)) == c
            got[g] += c
        assert own.weight([b"none"]) == 0 and own.weight([b"the"] * 5) == 0
    assert got == {g: c for g, c in want.items() if c >= 3}
    assert sum(u.frequent(1)[2] for u in unions.values()) == sum(c for g, c in want.items() if len(g) == 1)
    assert slots > 1 or arcs < sum(len(x[0]) for half in halves for x in shard(half)[0])  # equal states are one
