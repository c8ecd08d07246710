import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_chars long, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], SCHEMA)


def brute(rows, length, keep="none"):
    seen = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    bodies = {i: (rows[i][1] or "").encode() for i in order}
    for i in order:
        for at in range(len(bodies[i]) - length + 1):
            seen[bodies[i][at : at + length]].append((i, at))
    hit = {i: np.zeros(len(b), bool) for i, b in bodies.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, at in places[1:] if keep == "first" else places:
                hit[i][at : at + length] = True
    out = []
    for i in order:
        spans = int((np.diff(np.concatenate([[0], hit[i].astype(int)])) == 1).sum())
        left = bytes(b for b, x in zip(bodies[i], hit[i], strict=True) if not x)
        out.append((str(rows[i][0]), len(bodies[i]), int(hit[i].sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(scale, seed=2):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choices("abcdefgh ijklé\n", k=n))
    passages = [say(rng.randint(scale, 3 * scale)) for _ in range(4)] + [say(scale - 1), say(scale // 2)]
    rows = [(i, say(rng.randint(0, 6 * scale))) for i in range(25)]
    for i in range(30):
        rows.append((100 + i, say(rng.randint(0, scale)) + rng.choice(passages) + say(rng.randint(0, scale)) + rng.choice(passages)))
    base = say(8 * scale)
    for i in range(12):  # near copies
        at = rng.randrange(len(base))
        rows.append((200 + i, base[:at] + "#" + base[at + 1 :]))
    rows += [(300 + i, base) for i in range(4)]
    rows += [(400, "ab" * 3 * scale), (401, "z" * 4 * scale), (402, None), (403, ""), (None, base[: 3 * scale]), (404, passages[0] + say(9) + passages[0])]
    return rows


def run(spark, rows, **more):
    return sorted((str(r[0]), *r[1:]) for r in sd.measure(frame(spark, rows), **more).collect())


@pytest.mark.parametrize("keep", ["none", "first"])
def test_matches_brute_force(spark, keep):
    rows = corpus(40)
    assert run(spark, rows, length=40, gram=13, keep=keep) == brute(rows, 40, keep)


def test_matches_brute_force_at_full_length(spark, monkeypatch):
    rows = corpus(420, seed=5)
    assert run(spark, rows) == brute(rows, sd.LENGTH)
    rows.append((500, "".join(t or "" for _, t in rows)))
    monkeypatch.setattr(sd, "BUFFER", 3000)  # long texts in slices
    assert run(spark, rows) == brute(rows, sd.LENGTH)


def test_common_anchors_lose_nothing(spark):
    rows = corpus(40, seed=9)
    assert run(spark, rows, length=40, gram=13, most=2) == brute(rows, 40)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_whole_strings_lose_nothing(spark, keep):
    rows = corpus(40, seed=9)
    assert run(spark, rows, length=40, gram=13, most=0, keep=keep) == brute(rows, 40, keep)


def test_repeated_rows_empty_table_and_removal(spark):
    rows = [(1, "x" * 50 + "tail"), (1, "x" * 50 + "tail"), (2, "short")]
    assert run(spark, rows, length=40, gram=13) == brute(rows, 40)
    assert run(spark, []) == []
    same = "".join(map(chr, range(0xC0, 0xDE)))  # two bytes each
    kept = sd.remove(frame(spark, [(1, same + "one"), (2, "twoÀ" + same[:-1] + "Ā")]), length=40, gram=13)
    assert kept.columns == ["doc_id", "text", "n_chars", "spans"]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == [(1, same + "one", 33), (2, "twoÀĀ", 5)]


@pytest.mark.parametrize("most", [512, 0])
def test_repeated_rows_stay_first_beside_a_shared_passage(spark, most):
    rng = random.Random(1)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = say(60)
    first, last = say(30) + passage + say(30), [say(30), say(30)]
    kept = sd.remove(frame(spark, [(1, first), (1, first), (2, last[0] + passage + last[1])]), length=40, gram=13, most=most)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, first), (1, first), (2, "".join(last))]


def test_suffix_ranks_sort_by_prefix():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 300).astype(np.uint8)
    rank = sd.suffix_ranks(data, 20)
    raw = data.tobytes()
    want = {s: i for i, s in enumerate(sorted({raw[i : i + 20] for i in range(300)}))}
    assert list(rank) == [want[raw[i : i + 20]] for i in range(300)]


def test_previous_factors_match_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 60, 200):
        raw = rng.integers(0, 2, n).astype(np.uint8).tobytes()
        shared = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or raw[i + k] != raw[j + k]), 0)  # noqa: E731,B023
        order = np.array(sorted(range(n), key=lambda i: raw[i:]), np.int64)  # noqa: B023
        common = np.array([0] + [shared(i, j) for i, j in zip(order[:-1], order[1:], strict=True)], np.int64)[:n]
        got = dict(zip(order.tolist(), sd.previous_factors(order, common).tolist(), strict=True))
        assert got == {i: max((shared(i, j) for j in range(i)), default=0) for i in range(n)}


def test_ids_of_any_type(spark):
    same = "a passage that is here twice, and long enough. "
    rows = spark.createDataFrame([("doc-b", same + "one"), ("doc-a", "two " + same), (None, same + "three")], "doc_id string, text string")
    kept = {r.doc_id: r.text for r in sd.remove(rows, length=40, gram=13).collect()}
    assert same in kept["doc-a"] and same not in kept["doc-b"] and same not in kept[None]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_ranges_of_a_row_are_apart(spark, keep):
    rows = corpus(40)
    listed = [r.spans for r in sd.repeats(frame(spark, rows), length=40, gram=13, keep=keep).collect()]
    assert any(len(spans) > 1 for spans in listed)
    assert all(a["to"] < b["from"] for spans in listed for a, b in zip(spans, spans[1:], strict=False))


def test_query_tells_what_is_left(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdefghé", k=rng.randint(6, 9))) for _ in range(n)) + " "
    passage, shorter = say(70), say(40)
    assert len(shorter.encode()) < sd.LENGTH < len(passage.encode())
    alone = [(i, say(120)) for i in range(4)] + [(i, say(9) + shorter) for i in (5, 6)] + [(7, None), (8, "")]
    planted = [(10 + i, say(30) + passage + say(30)) for i in range(3)]
    run = "".join(map(chr, range(0xC0, 0xFF))) * 4
    split = [(20, "À" + run + "à"), (21, "Ā" + run + "á")]  # they share a byte of the characters beside it
    rows = alone + planted + split
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = sd.op9_suffix_lpf(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = {r.doc_id: r for r in out.collect()}
    assert sorted((str(r[0]), *r[1:5]) for r in got.values()) == brute(rows, sd.LENGTH)
    assert all(got[i].text == text and got[i].n_removed == 0 for i, text in alone)
    assert any(got[i].n_bytes > len(text or "") for i, text in alone)
    for i, text in planted:
        left = got[i].text
        assert passage.strip() not in left and len(left.encode()) == got[i].n_bytes - got[i].n_removed
        assert hashlib.sha256(left.encode()).hexdigest() == got[i].kept_sha256
    assert {i: got[i].text for i, _ in split} == {20: "Àà", 21: "Āá"}
    assert {i: r.text for i, r in got.items()} == {r.doc_id: r.text for r in sd.remove(frame(spark, rows), keep="none").collect()}


def test_query_keeps_bytes_that_are_no_utf8(spark, tmp_path):
    rows = frame(spark, [(1, "FF61FE"), (2, "62")]).selectExpr("doc_id", "cast(unhex(text) as string) as text")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sd.op9_suffix_lpf(spark, str(tmp_path)).selectExpr("doc_id", "n_bytes", "hex(cast(text as binary))", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == [(1, 3, "FF61FE", hashlib.sha256(b"\xffa\xfe").hexdigest()), (2, 1, "62", hashlib.sha256(b"b").hexdigest())]
