"""SentencePiece BPE by vectorised merge rounds over flat symbol arrays; decoding by a table of bytes.

A space is put before the text, which falls into words that start with spaces (U+2581 to the model): no piece reaches over
the start of a word. All words not met before lie in one flat array of symbols. In a round every word takes its pair of
the least rank, all leftmost places of that pair that do not overlap are merged at once, and the array is compacted; words
without a pair leave it. Where a merge could make a pair that ranks no lower than its own (or ranks tie, as they do for runs
of U+2581), only the leftmost place of the word is merged in a round, which is the order of the library's queue.

A long word need not wait for its one least pair: a pair that no other within twice the length of the longest piece outranks can
be merged at once, for whatever could take one of its symbols first would have to begin with a better pair inside that distance.

Defined results: null text counts as empty and gives no ids; a character without a piece becomes the ids of its bytes; texts of
any length are read whole, very long ones a run of words at a time; repeated rows each get a row; an empty table gives an empty
result; columns besides the key and the text are ignored, whatever their names. Decoding gives U+FFFD for each byte that is not
UTF-8. Models that are not BPE, normalise text, drop spaces or hold user-defined pieces are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import pieces, table, values

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MAX_WORDS, LONG_WORD = 120_000, 48  # words that are kept, and the longest that is
TOGETHER = 400_000  # characters of short texts that are encoded together
STREAM = 100_000  # words of a long text that are held at once
WINDOWED = 96  # symbols from which a word is merged by windows
NONE = np.int32(2**31 - 1)

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def _message(raw: bytes):
    """(field, value) of a protocol buffer message."""
    def varint(at):
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of each id of a model file."""
    found, trainer, normalizer = [], {}, {}
    for field, value in _message(raw):
        if field == 1:
            p = dict(_message(value))
            found.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_message(value))
        elif field == 3:
            normalizer = dict(_message(value))
    plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24, 0)
    if trainer.get(3) != 2 or not trainer.get(35) or not plain or any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for *_, kind in found):
        raise ValueError("only BPE models with byte fallback, without normalisation and user-defined pieces, are read")
    if any(SPACE in p[1:] and p.strip(SPACE) for p, _, kind in found if kind == NORMAL):
        raise ValueError("a piece reaches over the start of a word")
    return found


class Pieces:
    """The tables of a model: symbols, pairs and their ranks."""

    def __init__(self, raw: bytes):
        model = read_model(raw)
        self.names = [str(i) for i in range(len(model))]
        symbol = {p: i for i, (p, _, kind) in enumerate(model) if kind == NORMAL}
        byte_ids = {int(p[3:5], 16): str(i) for i, (p, _, kind) in enumerate(model) if kind == BYTE}
        self.spelled = lambda c: ",".join(byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))
        for c in sorted({c for p in symbol for c in p} - symbol.keys()):  # characters that only occur inside pieces
            symbol[c] = len(self.names)
            self.names.append(self.spelled(c))
        # A character that no piece has is the symbol ``base`` plus its code point: it never merges.
        self.base = len(self.names)
        self.of_code = np.arange(0x110000, dtype=np.int32) + np.int32(self.base)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_code[ord(p)] = i
        self.of_code[ord(" ")] = self.of_code[ord(SPACE)]
        scores = sorted({model[i][1] for p, i in symbol.items() if i < len(model)}, reverse=True)
        place = {s: n for n, s in enumerate(scores)}
        rank_of = np.full(self.base, NONE, np.int32)
        for p, i in symbol.items():
            if i < len(model):
                rank_of[i] = place[model[i][1]]
        keys, made, held = [], [], np.bincount(rank_of[rank_of < NONE], minlength=len(scores)) == 1
        for p, i in symbol.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
                    for part in (a, b):  # a merge that makes ``part`` may be followed by one that ranks no lower
                        if len(p) > 1 and rank_of[i] <= rank_of[part] < NONE:
                            held[rank_of[part]] = False
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.rank_of, self.safe = rank_of, np.append(held, False)  # ranks whose merges may be made together
        self.reach = max(map(len, symbol), default=1)
        run = max((len(p) for p in symbol if not p.strip(SPACE)), default=1)
        closed = len(self.merged([" " * run])[0].split(",")) == 1
        # A run of spaces fills the longest piece of spaces first, which nothing joins any more.
        self.words = re.compile((f" {{{run}}}(?= )|" if closed else "") + " +[^ ]*")
        self.bytes_of = {str(i): bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for i, (p, _, kind) in enumerate(model)}
        self.spaced = {str(i) for i, (p, _, kind) in enumerate(model) if kind == NORMAL and p.startswith(SPACE)}
        self.known: dict[str, str] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) that each pair of symbols makes."""
        if not len(self.keys):
            return np.full(len(left), NONE), np.zeros(len(left), np.int32)
        asked = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        piece = self.made[at]
        return np.where(self.keys[at] == asked, self.rank_of[piece], NONE), piece

    def least_near(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least rank within twice ``reach`` places before each place, and on either side and there."""
        wide, size, need = np.concatenate([np.full(2 * self.reach, NONE), rank, np.full(2 * self.reach, NONE)]), 1, 2 * self.reach
        while size < need:  # minima over ``size`` places, doubled until they span the window
            step = min(size, need - size)
            wide = np.minimum(wide[:-step], wide[step:])
            size += step
        before, after = wide[: len(rank)], wide[need + 1 :]
        return before, np.minimum(np.minimum(before, rank), after)

    def merged(self, words: list[str]) -> list[str]:
        """The ids of each word, as decimal text joined by commas, by rounds of merges over all words."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.of_code[codes], np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self.pairs(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            starts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            sizes = np.diff(starts, append=len(sym))
            least = np.minimum.reduceat(rank, starts)
            if (ended := least == NONE).any():
                out = np.repeat(ended, sizes)
                done.append((word[out], sym[out]))
                word, sym, rank, made = (x[~out] for x in (word, sym, rank, made))
                continue
            lowest = np.repeat(least, sizes)
            bound = lowest
            long = np.flatnonzero(sizes > WINDOWED)
            if len(long):
                bound, leftmost = lowest.copy(), np.zeros(len(sym), bool)
            for n in long:
                own = slice(starts[n], starts[n] + sizes[n])
                before, bound[own] = self.least_near(rank[own])
                leftmost[own] = before > rank[own]
            hit = (rank == bound) & (rank < NONE)
            together = self.safe[np.minimum(rank, len(self.safe) - 1)]
            # Of pairs of one rank that overlap in a row every other one is merged, from the first on.
            again = np.concatenate([[False], rank[1:] == rank[:-1]])
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(rank))))
            take = hit & together & hit[first] & ((np.arange(len(rank)) - first) % 2 == 0)
            alone = hit & ~together
            if len(long):
                take |= alone & leftmost
                alone &= np.repeat(sizes <= WINDOWED, sizes)
            alone = np.flatnonzero(alone)
            take[alone[np.append(True, word[alone[1:]] != word[alone[:-1]])[: len(alone)]]] = True
            at = np.flatnonzero(take)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            word, sym, rank, made = (x[keep] for x in (word, sym, rank, made))
            at -= np.arange(len(at))
            touched = np.zeros(len(sym) + 1, bool)
            touched[at] = touched[at - 1] = True  # of place 0 the one before is a spare
            touched = np.flatnonzero(touched[:-1])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], made[touched] = self.pairs(sym[touched], sym[touched + 1])
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(word, kind="stable")
        names, base = self.names, self.base
        flat = [names[s] if s < base else self.spelled(chr(s - base)) for s in sym[order].tolist()]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [",".join(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self.merged(new), strict=True))

    def forget(self) -> None:
        """Keep a bounded table of short words."""
        if len(self.known) > MAX_WORDS:
            self.known.clear()

    def spread(self, text: str) -> str:
        """The text with a space before it; U+2581 is a space as well."""
        return " " + text.replace(SPACE, " ") if text else ""

    def encode(self, text: str):
        """The ids as decimal text joined by commas, in runs of words."""
        words = (m.group() for m in self.words.finditer(self.spread(text)))
        while run := list(islice(words, STREAM)):
            self.forget()
            self.learn(set(run))
            yield ",".join(map(self.known.__getitem__, run))
            for w in {w for w in run if len(w) > LONG_WORD}:
                self.known.pop(w, None)

    def encode_together(self, texts: list[str]):
        """(text, its runs of ids) for each text; the words of neighbouring short texts are merged in one go."""
        group: list[str] = []

        def given():
            self.forget()
            split = [self.words.findall(self.spread(t)) for t in group]
            self.learn(set(chain.from_iterable(split)))
            for t, run in zip(group, split, strict=True):
                yield t, [",".join(map(self.known.__getitem__, run))] if run else []
            for w in {w for run in split for w in run if len(w) > LONG_WORD}:
                self.known.pop(w, None)

        held = 0
        for t in texts:
            if held + len(t) > TOGETHER and group:
                yield from given()
                group, held = [], 0
            if len(t) > TOGETHER:
                yield t, self.encode(t)
            else:
                group.append(t)
                held += len(t)
        if group:
            yield from given()

    def decode(self, runs):
        """Text of runs of ids, as far as complete. The space before the first word is dropped."""
        machine = codecs.getincrementaldecoder("utf-8")("each-byte")
        fresh = True
        for run in runs:
            ids = run.split(",") if run else []
            raw = list(map(self.bytes_of.__getitem__, ids))
            if fresh:
                at = next((n for n, part in enumerate(raw) if part), None)  # control pieces have no text
                if at is not None:
                    fresh = False
                    raw[at] = raw[at][1:] if ids[at] in self.spaced else raw[at]
            yield machine.decode(b"".join(raw))
        yield machine.decode(b"", True)


_held: dict[bytes, Pieces] = {}


def model_of(raw: bytes) -> Pieces:
    key = hashlib.sha256(raw).digest()
    if key not in _held:
        _held.clear()
        _held[key] = Pieces(raw)
    return _held[key]


def _shared(spark: SparkSession, path: str | None):
    """The model file's bytes, of fixed size, for all tasks."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _numbers(runs) -> np.ndarray:
    held = [np.fromstring(r, np.int32, sep=",") for r in runs if r]
    return np.concatenate(held) if held else np.zeros(0, np.int32)


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``: the ids of each whole text."""
    raw = _shared(docs.sparkSession, path)

    def run(batches):
        own = model_of(raw.value)
        for batch in pieces(batches):
            made = [_numbers(runs) for _, runs in own.encode_together([t or "" for t in values(batch.column(1))])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of lists of ids; an id that the model lacks is an error."""
    raw = _shared(encoded.sparkSession, path)

    def run(batches):
        own = model_of(raw.value)
        for batch in pieces(batches):
            made = ["".join(own.decode([",".join(map(str, x))] if x else [])) for x in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``, encoding and decoding in one streamed pass."""
    raw = _shared(docs.sparkSession, path)

    def digests(own: Pieces, runs):
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()

        def counted():
            nonlocal n
            for part in runs:
                ids.update((("," if n else "") + part).encode())
                n += part.count(",") + 1
                yield part

        for part in own.decode(counted()):
            back.update(part.encode("utf-8", "surrogatepass"))
        return n, ids.hexdigest(), back.hexdigest()

    def run(batches):
        own = model_of(raw.value)
        for batch in pieces(batches):
            made = [digests(own, runs) for _, runs in own.encode_together([t or "" for t in values(batch.column(1))])]
            cols = list(zip(*made, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True))], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
