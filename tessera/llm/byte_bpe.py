"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

Encoding rests on a property of rank-merged BPE: a token sequence is the encoding of its bytes
exactly when merging leaves every token and every neighbouring pair of tokens as they are. So each
prefix of a piece has one last token, and reading bytes left to right only needs the open walks
through the trie of tokens. A state is the set of open walks; it is made when first reached, from
a table of bounded size. Each move also lists the tokens that may end with the byte, of which one
fits the token that ended where it starts. Fitting is decided by undoing the merges of both. A
walk is open for one token's length at most, so tokens before the walks' common past are certain
and are emitted; a piece costs time in proportion to its length. Pieces of text that come again
are looked up in a bounded table of two halves: the older one goes when the newer one is full, and
what is found in it moves over, so that frequent pieces stay.

Defined results: null text counts as empty and gives no ids; repeated rows each get a row; an
empty table gives an empty result; columns besides the key and the text are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import hold, pieces, table, values

MAX_STATES = 100_000
MAX_FITS = 250_000
MAX_PIECES = 240_000
MAX_HEADS = 50_000
HEAD = 6  # bytes after which the way of a piece is kept for others that begin alike
LONG_PIECE = 48
SETTLE = 4096  # bytes after which a long piece emits what is certain
STREAM = 200_000  # pieces of a text that are held at once


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class _State(dict):
    """byte -> (state of all walks that it leaves open, what may end with it); made when first reached."""

    __slots__ = ("owner", "walks")

    def __init__(self, owner: Transducer, walks: tuple):
        self.owner, self.walks = owner, walks

    def __missing__(self, byte: int) -> tuple[_State, tuple]:
        got = self[byte] = self.owner.move(self.walks, byte)
        return got


class _Fits(dict):
    """token before -> whether merging leaves it and the own token as they are; decided when first asked."""

    __slots__ = ("owner", "token")

    def __init__(self, owner: Transducer, token: int):
        self.owner, self.token = owner, token

    def __missing__(self, before: int) -> bool:
        self.owner.make_room()
        got = self[before] = self.owner.may_follow(before, self.token)
        return got


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.at_node: dict[int, int] = {}
        n = 1
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = n
                    n += 1
            self.at_node[node] = rank
        self.inner = {key >> 8 for key in self.child}
        self.longest = max(map(len, ranks), default=0)
        self.fits: dict[int, _Fits] = {}
        self.n_fits = 0
        self.last_merge: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Start the table of states again; they are made anew when reached."""
        self.states = {(0,): _State(self, (0,))}
        self.heads: dict[bytes, tuple[_State, tuple, tuple]] = {}

    def make_room(self) -> None:
        """Empty the table of fits, which the states refer to, before it holds too many."""
        self.n_fits += 1
        if self.n_fits > MAX_FITS:
            for known in self.fits.values():
                known.clear()
            self.n_fits = 1

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; null for one byte or what merging never makes."""
        got = self.last_merge.get(token, 0)
        if got == 0:
            piece = self.token_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self.last_merge[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return got

    def stands_alone(self, token: int) -> bool:
        return len(self.token_of[token]) == 1 or self.halves(token) is not None

    def may_follow(self, before: int, token: int) -> bool:
        """Whether merging leaves the two as they are.

        Undoes the merges on both sides of the border, the latest first; the border falls if the
        two tokens then at it would have been joined before the merge that was undone.
        """
        got = self.stands_alone(token)
        if got and before >= 0:
            left, right, until_left, until_right = before, token, 1 << 60, 1 << 60
            while True:
                joined = self.ranks.get(self.token_of[left] + self.token_of[right], 1 << 60)
                # Of equal merges the one further left comes first.
                if joined < until_left and joined <= until_right and joined < 1 << 60:
                    got = False
                    break
                lefts, rights = self.halves(left), self.halves(right)
                if lefts is None and rights is None:
                    break
                if rights is None or (lefts is not None and left > right):
                    until_left, left = left, lefts[1]
                else:
                    until_right, right = right, rights[0]
        return got

    def move(self, open_walks: tuple, byte: int) -> tuple[_State, tuple]:
        """The state of all walks that a byte leaves open, and (token, length, fits) of what may end with it."""
        walks, ends = [], []
        for node in open_walks:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if to in self.inner:  # else the walk can only end here
                walks.append(to)
            token = self.at_node.get(to)
            if token is not None and self.stands_alone(token):
                known = self.fits.get(token)
                if known is None:
                    known = self.fits[token] = _Fits(self, token)
                ends.append((token, len(self.token_of[token]), known))
        made = (*walks, 0)
        state = self.states.get(made)
        if state is None:
            state = self.states[made] = _State(self, made)
        return state, tuple(ends)

    def settle(self, last: list, sizes: list, out: list, window: int) -> None:
        """Emit the tokens that all open walks agree on, and drop them."""
        ends = set(range(max(0, len(last) - 1 - window), len(last)))
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - sizes[end])
        at = root = ends.pop()
        sure = []
        while at > 0:
            sure.append(last[at])
            at -= sizes[at]
        out += sure[::-1]
        del last[:root], sizes[:root]
        sizes[0] = 0

    def walk(self, piece: bytes, state: _State, last: list, sizes: list, out: list) -> _State:
        """Read bytes on; ``last`` and ``sizes`` have for each place the token that ends the prefix up to it, and its length."""
        n = len(last) - 1
        for byte in piece:
            state, ends = state[byte]
            n += 1
            for token, size, fits in ends:
                if fits[last[n - size]]:
                    break
            last.append(token)
            sizes.append(size)
            if n > SETTLE:
                self.settle(last, sizes, out, self.longest)
                n = len(last) - 1
        return state

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self.forget()
        out, head = [], piece[:HEAD]
        known = self.heads.get(head)
        if known is not None:
            state, last, sizes = known[0], [*known[1]], [*known[2]]
        else:
            last, sizes = [-1], [0]
            state = self.walk(head, self.states[(0,)], last, sizes, out)
            if len(self.heads) >= MAX_HEADS:
                self.heads.clear()
            self.heads[head] = state, tuple(last), tuple(sizes)
        if len(piece) > HEAD:
            self.walk(piece[HEAD:], state, last, sizes, out)
        tail, at = [], len(last) - 1
        while at > 0:
            tail.append(last[at])
            at -= sizes[at]
        return out + tail[::-1] if out else tail[::-1]


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, raw: bytes, pattern: str):
        self.transducer = Transducer(read_ranks(raw))
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.name = {rank: str(rank) for rank in self.transducer.token_of}
        self.token_of = {self.name[rank]: token for rank, token in self.transducer.token_of.items()}

    def piece(self, piece: str) -> str:
        got = self.older.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            got = ",".join(map(self.name.__getitem__, self.transducer.encode_piece(raw)))
            if len(raw) > LONG_PIECE:
                return got
        if len(self.pieces) >= MAX_PIECES:
            self.older = self.pieces.copy()
            self.pieces.clear()
        self.pieces[piece] = got
        return got

    def encode(self, text: str):
        """The ids as decimal text joined by commas, in runs of pieces."""
        pieces, known, one = self.pattern.finditer(text), self.pieces, self.piece
        if len(text) <= STREAM:
            found = self.pattern.findall(text)
            if found:
                yield ",".join([known.get(p) or one(p) for p in found])
            return
        while run := [m.group() for m in islice(pieces, STREAM)]:
            yield ",".join([known.get(p) or one(p) for p in run])

    def decode(self, runs):
        """Text of runs of ids, as far as complete; a sequence cut between tokens waits for its rest."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for run in runs:
            yield machine.decode(b"".join(map(self.token_of.__getitem__, run.split(","))))
        yield machine.decode(b"", True)


_codecs: dict[tuple, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    hold("byte_bpe", _codecs.clear)
    return _codecs[key]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The vocabulary file's bytes, of fixed size, for all tasks."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``: the token ids of each whole text."""
    raw, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches):
        own = codec(raw.value, pattern)
        for batch in batches:
            made = [[int(i) for part in own.encode(t or "") for i in part.split(",")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of token ids; bytes that are not UTF-8 become U+FFFD."""
    raw, pattern = _vocabulary(encoded.sparkSession, path, None)

    def run(batches):
        own = codec(raw.value, pattern)
        for batch in batches:
            made = ["".join(own.decode([",".join(map(str, x))] if x else [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``, encoding and decoding in one streamed pass.

    With ``with_ids``, the ids too.
    """
    raw, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def digests(own: Codec, body: str):
        n, ids, back, held = 0, hashlib.sha256(), hashlib.sha256(), []

        def counted():
            nonlocal n
            for part in own.encode(body):
                ids.update((("," if n else "") + part).encode())
                n += part.count(",") + 1
                if with_ids:
                    held.append(np.fromstring(part, np.int32, sep=","))
                yield part

        for part in own.decode(counted()):
            back.update(part.encode("utf-8", "surrogatepass"))
        return n, ids.hexdigest(), back.hexdigest(), *([np.concatenate(held) if held else np.zeros(0, np.int32)] if with_ids else [])

    def run(batches):
        own = codec(raw.value, pattern)
        for batch in pieces(batches, keep="byte_bpe"):
            made = [digests(own, t or "") for t in values(batch.column(1))]
            cols = list(zip(*made, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[key, *names],
            )

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
