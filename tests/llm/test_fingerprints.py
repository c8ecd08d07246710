import hashlib
import unicodedata

from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string, h string"


def canon(t):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(x.split())


def expected(rows):
    """Rows in descending doc_id, each with its next."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(n)))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


ROWS = [(i, t) for i, t in enumerate([
    "Straße  und\tÉcole", "STRASSE und École ", "ab", "AB", "ab", None, "", " ", "x" * 40_000, "🙂🙃 mixed ﬁ", "🙂🙃 mixed fi", "odd one", "same same", "same same",
])]


def test_rows_match_plain_python(spark):
    rows = [*ROWS, (None, "no key")]
    got = fp.compare_with_edits(frame(spark, rows)).collect()
    assert {tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")) for r in got} == set(expected(rows))
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        for j, u in rows:
            assert (by[i].fingerprint == by[j].fingerprint) == (canon(t or "") == canon(u or "")), (t, u)


def test_ranges_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 20)
    rows = [(i * i * 7 % 10007 - 500, f"text {i}") for i in range(700)] + [(None, "no key")]
    rows = list({r[0]: r for r in rows}.values())
    got = fp.compare_with_edits(frame(spark, rows)).collect()
    assert {(r[0], r[1], r[2], r[5], r[6]) for r in got} == set(expected(rows)) and len(got) == len(rows)


def test_many_ranges_repeats_and_small_tables(spark):
    rows = [(i * 7 % 1009, f"text {i}") for i in range(1009)]
    got = fp.compare_with_edits(frame(spark, rows)).collect()
    assert {(r[0], r[1], r[2], r[5], r[6]) for r in got} == set(expected(rows)) and len(got) == 1009
    assert len(fp.compare_with_edits(frame(spark, [(1, "a"), (1, "a"), (None, "b"), (None, "b")])).collect()) == 4
    assert [r.near_next for r in fp.compare_with_edits(frame(spark, [(1, "lone")])).collect()] == [1.0]
    assert fp.compare_with_edits(frame(spark, [])).collect() == []


def test_unequal_bytes_in_a_bucket_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fp, "wide_hash", lambda c: F.struct(F.length(c).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz"), (5, "XYZ")]
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[3] != got[2] and got[4] == got[5] and "-" in got[1] and "-" not in got[4]
    got = {r.doc_id: r.fingerprint for r in fp.compare_with_edits(frame(spark, rows)).collect()}
    assert got[1] == got[3] != got[2] and got[4] == got[5]


def test_ids_of_any_type(spark):
    """Text ids, of which none is a number: the next document is that of the next smaller id."""
    rows = [(f"d{i:03d}", t) for i, t in ROWS if i is not None] + [(None, "last of all"), ("d001", "again")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""), reverse=True)
    got = fp.compare_with_edits(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    nexts = {i: n or "" for (i, _), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    seen = {r.doc_id: r for r in got}
    for i, t in rows:
        if i not in ("d000", "d001", "d002", None):  # the order of rows that share an id is their texts'
            t, n = t or "", nexts[i]
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert seen[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
