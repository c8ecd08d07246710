import random

import pytest

import corpus_pipeline
from tessera.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA)


def brute(rows, words):
    """What is left, as words: of equal runs of that many words only the first stays."""
    seen, out = set(), []
    for i, t in sorted(rows):
        tokens = t.encode().split()
        gone = set()
        for at in range(len(tokens) - words + 1):
            run = tuple(tokens[at : at + words])
            if run in seen:
                gone |= set(range(at, at + words))
            seen.add(run)
        out.append((i, [w.decode() for n, w in enumerate(tokens) if n not in gone]))
    return out


def corpus(scale):
    rng = random.Random(6)
    say = lambda n: [rng.choice(["a", "é", "the", "ocean", "w%d" % rng.randrange(500)]) for _ in range(n)]
    passages = [say(n) for n in (scale - 1, scale, scale, scale + 1, 2 * scale, 4 * scale)]
    passages.append(["a"] * 2 * scale)
    rows = []
    for i in range(60):
        words = say(rng.randrange(2 * scale))
        for p in rng.choices(passages, k=2):
            words += p + say(rng.randrange(1, scale))
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  ", "\t "]) for w in words)))
    return rows


@pytest.mark.parametrize("more", [{}, {"most": 2}])
def test_words_match_brute_force(spark, more):
    rows = corpus(9)
    got = sorted((r.doc_id, r.text.split()) for r in sd.remove(frame(spark, rows), words=9, **more).collect())
    assert got == brute(rows, 9)


def test_stage_cuts_passages_of_51_words(spark):
    passage = " ".join(f"w{i:02}" for i in range(51))  # 203 bytes
    shorter = " ".join(f"v{i:02}" for i in range(50))
    docs = [(1, f"one {passage} two {shorter}"), (2, f"three\n{passage.replace(' ', '  ')}\nfour {shorter} five"), (3, "six " + passage), (4, passage)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, frame(spark, docs), "").collect()}
    left = {1: docs[0][1], 2: f"three\nfour {shorter} five", 3: "six ", 4: ""}
    assert got == {i: (t, len(t)) for i, t in left.items()}


def test_stage_matches_brute_force(spark):
    rows = corpus(51)
    got = sorted((r.doc_id, r.text.split()) for r in corpus_pipeline.repeated_passages(spark, frame(spark, rows), "").collect())
    assert got == brute(rows, 51)


@pytest.mark.parametrize("more", [{}, {"most": 2}])
def test_stretches_of_a_short_period_are_one_row(spark, monkeypatch, more):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        words = ["u%d" % rng.randrange(10_000) for _ in range(30)]
        for period in (["on", "and"], ["a"], ["one", "two", "three", "four", "five"], ["one", "two"]):
            words += (period * 200)[: 150 + i] + ["v%d" % rng.randrange(10_000) for _ in range(20)]
        rows.append((i, " ".join(words)))
    made, stage = [], sd.stage

    def counted(df, tag):
        out = stage(df, tag)
        if tag == "lpf-whole":
            made.append(out.count())
        return out

    monkeypatch.setattr(sd, "stage", counted)
    got = sorted((r.doc_id, r.text.split()) for r in sd.remove(frame(spark, rows), words=9, **more).collect())
    assert got == brute(rows, 9)
    assert made[0] <= 40 * 4 * 3  # a few rows a stretch, not one a period


def test_no_task_runs_two_python_operators(spark, monkeypatch):
    read, anchors = [], sd._anchors

    def noted(rows, *more):
        read.append(rows._jdf.queryExecution().executedPlan().toString())
        return anchors(rows, *more)

    monkeypatch.setattr(sd, "_anchors", noted)
    rows = corpus(9)
    got = sorted((r.doc_id, r.text.split()) for r in sd.remove(frame(spark, rows), words=9, most=2).collect())
    assert got == brute(rows, 9)
    assert len(read) > 1 and not any("MapInArrow" in plan for plan in read)
