import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import byte_bpe

RAW = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RAW), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(RAW, public_tokenizers.PATTERN)


def ids(own, text):
    return [int(i) for part in own.encode(text) for i in part.split(",")]


def samples():
    rng = random.Random(5)
    alphabets = ["abcdefgh", "the and of ing", "aA1!? \n\t", "éüñßç ", "日本語のテスト", "🙂👍🏽é", "\x00\x1c\x1f\x85᠎ 　 a", "Привет мир", "١٢٣½Ⅷ a"]
    for _ in range(3000):
        yield "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60)))
    yield from ("", " " * 500, "a" * 3000, "ab" * 1500, "<|endoftext|>", "it's we'll I'D", "\r\n \r\n\n  x", "the" * 800)
    yield "".join(rng.choices("".join(map(chr, [*range(0x20, 0x250), *range(0x370, 0x500), *range(0x4E00, 0x4F00)])), k=4000))


def test_ids_equal_the_library(own, library):
    for text in samples():
        assert ids(own, text) == library.encode_ordinary(text), repr(text[:80])


def test_every_code_point_splits_alike(own, library):
    for at in range(0, 0x110000, 0x800):
        if 0xD800 <= at < 0xE000:
            continue
        text = "x".join(map(chr, range(at, at + 0x800)))
        assert ids(own, text) == library.encode_ordinary(text), hex(at)


def test_states_can_be_forgotten(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 50)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 20)
    for text in list(samples())[:400]:
        assert ids(own, text) == library.encode_ordinary(text)


def test_long_texts_stream(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STREAM", 37)
    monkeypatch.setattr(byte_bpe, "SETTLE", 300)
    assert ids(own, "ab the" * 900 + "z" * 2000) == library.encode_ordinary("ab the" * 900 + "z" * 2000)
    text = "Some words, é and 日本 " * 300
    assert ids(own, text) == library.encode_ordinary(text)
    assert "".join(own.decode(own.encode(text))) == text


def test_decoding_waits_for_cut_characters(own):
    first, second = (own.transducer.ranks[bytes([b])] for b in "é".encode())
    assert list(own.decode([str(first), str(second)])) == ["", "é", ""]
    assert "".join(own.decode([str(first)])) == "�"


def test_frames(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "é" * 9, "x"), (1, "Hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs).collect()}
    want = set()
    for i, t, _ in rows:
        made = library.encode_ordinary(t or "")
        want.add((i, len(made), hashlib.sha256(",".join(map(str, made)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert byte_bpe.round_trip(docs.limit(0)).collect() == []


def test_frequent_pieces_stay_and_heads_are_bounded(library, monkeypatch):
    made = byte_bpe.Codec(RAW, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 12)
    monkeypatch.setattr(byte_bpe, "MAX_HEADS", 2)
    monkeypatch.setattr(byte_bpe, "MAX_FITS", 40)
    encoded, encode = [], made.transducer.encode_piece
    monkeypatch.setattr(made.transducer, "encode_piece", lambda raw: encoded.append(raw) or encode(raw))
    for i in range(40):
        text = f" zqxvoften zqxvo{i:03d}x zqxvrare{chr(97 + i % 26)}q"
        assert [int(x) for part in made.encode(text) for x in part.split(",")] == library.encode_ordinary(text)
    assert encoded.count(b" zqxvoften") == 1 and len(made.pieces) <= 12 and len(made.transducer.heads) <= 2
    assert made.transducer.n_fits <= 40


def test_other_operators_drop_the_tables(own):
    from tessera.llm.common import pieces

    byte_bpe.codec(RAW, public_tokenizers.PATTERN)
    assert list(pieces([], keep="byte_bpe")) == [] and byte_bpe._codecs
    assert list(pieces([])) == [] and not byte_bpe._codecs
