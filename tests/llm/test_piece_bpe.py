import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return piece_bpe.model_of(f.read())


def ids(own, text):
    return [int(i) for part in own.encode(text) for i in part.split(",")]


ALPHABETS = ["abcdefgh", "the and of ing ", "aA1!? \n\t", "éüñßç ", "日本語のテスト", "🙂👍🏽é", "\x00\x1c\x1f\x85　 a", "Привет мир", "١٢٣½Ⅷ a", "▁ a", "aab", "    aa", "etaoinshrdlu"]


def samples():
    rng = random.Random(5)
    for _ in range(2500):
        yield "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(0, 60)))
    for _ in range(250):  # words that are merged by windows
        yield "".join(rng.choices(rng.choice(ALPHABETS) + rng.choice(ALPHABETS), k=rng.randint(90, 1500)))
    yield from ("", " ", "a" * 3000, "ab" * 1500, "the" * 800, "<s>", "<0x0A>", "</s> <unk>", "\r\n \r\n\n  x")
    yield "".join(rng.choices("".join(map(chr, [*range(0x20, 0x250), *range(0x370, 0x500), *range(0x4E00, 0x4F00)])), k=4000))


def test_ids_and_texts_equal_the_library(own, library):
    for text in samples():
        want = library.encode(text)
        assert ids(own, text) == want, repr(text[:80])
        assert "".join(own.decode(own.encode(text))) == library.decode(want), repr(text[:80])


def test_runs_of_spaces(own, library):
    for n in range(100):
        for text in (" " * n, " " * n + "word", "x" + " " * n, "x" + " " * n + "\n", "▁" * n + "x"):
            assert ids(own, text) == library.encode(text), (n, text[-5:])


def test_every_code_point(own, library):
    for at in range(0, 0x110000, 0x1000):
        if not 0xD800 <= at < 0xE000:
            text = "x".join(map(chr, range(at, at + 0x800)))
            assert ids(own, text) == library.encode(text), hex(at)


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(3)
    for _ in range(3000):
        made = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(made))
        runs = [",".join(map(str, part)) for part in (made[:cut], made[cut:]) if part]
        assert "".join(own.decode(runs)) == library.decode(made), made


def test_neighbours_and_long_texts(own, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "TOGETHER", 200)
    monkeypatch.setattr(piece_bpe, "STREAM", 7)
    monkeypatch.setattr(piece_bpe, "MAX_WORDS", 20)
    texts = [t for t in samples() if len(t) < 400][:700] + ["Some words, é and 日本 " * 90, "", "a"]
    got = [(t, [int(i) for r in runs for i in r.split(",")]) for t, runs in own.encode_together(texts)]
    assert [t for t, _ in got] == texts
    for t, made in got:
        assert made == library.encode(t)


def test_frames(spark, library):
    rows = [(1, "Hello  world", "x", 3), (2, None, "x", 3), (3, "", "x", 3), (None, "é" * 9 + "\U0001d518", "x", 3), (1, "Hello  world", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = {tuple(r) for r in piece_bpe.round_trip(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for i, t, *_ in rows:
        made = library.encode(t or "")
        want.add((i, len(made), sha(",".join(map(str, made))), sha(library.decode(made))))
    assert got == want
    back = piece_bpe.decode_documents(piece_bpe.encode_documents(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert piece_bpe.round_trip(docs.limit(0)).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.read_model(b"")
