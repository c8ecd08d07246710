"""Phrases whose words belong together, from counts held in weighted acyclic automata.

A task counts the word n-grams of a shard of texts, a language at a time, and builds from the sorted n-grams, deepest states
first, a minimal automaton: a path spells an n-gram, the weight of its last arc is the count, and a register makes states with
the same arcs one. The automaton is cut into ranges of n-grams in sorted order and dealt out by range; a range's task unites
what all shards have of it, adding up weights, and keeps what is frequent. Both parts of each way to cut a frequent phrase are
looked up by running them through the automaton of the range that they lie in.

Cuts between ranges come from n-grams of sampled texts and decide the balance only. The number of ranges grows with the text; beyond
``MAX_CUTS`` a range is split further by a hash of the n-gram, so the table of cuts that tasks get stays bounded. A phrase that
is common everywhere is one arc of each shard. Look-ups of one very common part are spread over copies of its range's automaton.

Defined results: null text counts as empty, null language as ``und``; texts are read whole; repeated rows count each; a word is
any run of bytes between spaces and tabs; of equal cuts the one after fewer words counts; an empty table, or one without
frequent phrases, gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, pieces, stage, table, values

WORDS = 4
SHARD = 2_000_000  # words that a task counts at once, a last text aside
RANGE_BYTES = 8 << 20  # text a range, on average
MAX_CUTS = 1 << 16
KEYS_A_RANGE, WORDS_A_KEY = 40, 50
UNITE = 2_000_000  # arcs that are held before they are added up
LOOKUPS = 20_000  # look-ups that go to one copy of an automaton
SPREAD = 32
BREAK = b"\xff"
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

PART = "range int, lang string, root int, sizes binary, labels binary, targets binary, weights binary, words binary"
COLUMNS = [c.split()[0] for c in PART.split(", ")]


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in lower case, with ``BREAK`` where a piece ends; no UTF-8 text holds that byte."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).replace(BREAK, b" \xff ").split()


# Levels: for n-grams of each number of words (parent, label, weight), sorted; parent is the place of the n-gram without its last word.


def counted(ranks: np.ndarray, base: int) -> list[tuple]:
    """Levels of the n-grams of words numbered from 1, which 0 separates."""
    levels, last = [], np.flatnonzero(ranks)
    node = np.zeros(len(last), np.int64)
    padded = np.append(ranks, 0)
    for m in range(WORDS):
        if m:
            on = padded[last + 1] > 0
            last, node = last[on] + 1, node[on]
        found, node, n = np.unique(node * base + padded[last], return_inverse=True, return_counts=True)
        levels.append((found // base, found % base, n.astype(np.int64)))
    return levels


def united(parts: list[list[tuple]], base: int) -> list[tuple]:
    """Levels of the union, with weights added up; the labels of all parts are numbers below ``base``."""
    out, moved = [], [np.zeros(1, np.int64) for _ in parts]
    for m in range(WORDS):
        keys = np.concatenate([at[p[m][0]] * base + p[m][1] for at, p in zip(moved, parts, strict=True)])
        found, at = np.unique(keys, return_inverse=True)
        weight = np.zeros(len(found), np.int64)
        np.add.at(weight, at, np.concatenate([p[m][2] for p in parts]))
        out.append((found // base, found % base, weight))
        moved = np.split(at, np.cumsum([len(p[m][0]) for p in parts])[:-1])
    return out


def restricted(levels: list[tuple], wanted: list[np.ndarray]) -> list[tuple]:
    """The wanted n-grams and, with weight 0, what leads to them."""
    keep = [w.copy() for w in wanted]
    for m in range(WORDS - 1, 0, -1):
        keep[m - 1][levels[m][0][keep[m]]] = True
    out, moved = [], np.zeros(1, np.int64)
    for (parent, label, weight), k, w in zip(levels, keep, wanted, strict=True):
        out.append((moved[parent[k]], label[k], np.where(w, weight, 0)[k]))
        moved = np.cumsum(k) - 1
    return out


def bounds(levels: list[tuple], cut: list[tuple[int, bool]]) -> list[int]:
    """How many n-grams of each level sort before a cut, given as (rank, whether the word is there) of its words."""
    out, low, exact = [], 0, True  # low: the first node of the level above that does not sort before the cut, exact: it leads to it
    for m, (parent, label, _) in enumerate(levels):
        begin, end = (np.searchsorted(parent, low), np.searchsorted(parent, low + 1)) if m else (0, len(label))
        if exact and m < len(cut):
            low = int(begin + np.searchsorted(label[begin:end], cut[m][0]))
            exact = cut[m][1] and low < end and label[low] == cut[m][0]
            out.append(low + (exact and m + 1 < len(cut)))  # a part of the cut sorts before it
        else:
            low, exact = int(begin), False
            out.append(low)
    return out


def sliced(levels: list[tuple], begins: list[int], ends: list[int]) -> list[tuple]:
    """The n-grams between two bounds and, with weight 0, what leads to them."""
    starts = list(begins)
    for m in range(WORDS - 1, 0, -1):
        if starts[m] < ends[m]:
            starts[m - 1] = min(starts[m - 1], int(levels[m][0][starts[m]]))
    out = []
    for m, (parent, label, weight) in enumerate(levels):
        s, e = starts[m], max(starts[m], ends[m])
        own = weight[s:e].copy()
        own[: begins[m] - s] = 0
        out.append((parent[s:e] - (starts[m - 1] if m else 0), label[s:e], own))
    return out


_ARC = np.dtype([("label", "<u4"), ("target", "<u4"), ("weight", "<i8")])


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes, in as few as the largest needs; the first byte says how many."""
    size = next(n for n in (1, 2, 4, 8) if n == 8 or not len(numbers) or int(numbers.max()) < 1 << 8 * n)
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def built(levels: list[tuple]) -> tuple[int, bytes, bytes, bytes, bytes]:
    """(root, sizes, labels, targets, weights) of the minimal automaton: state 0 has no arcs, the others lie one after the other."""
    register: dict[bytes, int] = {}
    state = np.zeros(len(levels[-1][0]), np.int64)
    for m in range(WORDS - 1, -1, -1):
        parent, label, weight = levels[m]
        arcs = np.empty(len(parent), _ARC)
        arcs["label"], arcs["target"], arcs["weight"] = label, state, weight
        raw = arcs.tobytes()
        starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
        cuts = np.append(starts, len(parent)) * _ARC.itemsize
        made = [register.setdefault(raw[a:b], len(register) + 1) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        state = np.zeros(len(levels[m - 1][0]) if m else 1, np.int64)
        state[parent[starts]] = made
    arcs = np.frombuffer(b"".join(register), _ARC)
    sizes = np.fromiter(map(len, register), np.int64, len(register)) // _ARC.itemsize
    return int(state[0]), *map(_packed, (sizes, arcs["label"], arcs["target"], arcs["weight"]))


class Automaton:
    """A part as read from its row."""

    def __init__(self, row: dict):
        self.root, self.words = row["root"], row["words"].split(b"\n") if row["words"] else []
        sizes, self.labels, self.targets, self.weights = (_unpacked(row[c]) for c in ("sizes", "labels", "targets", "weights"))
        self.ends = np.append(0, np.cumsum(sizes))
        self.begins = np.append(0, self.ends[:-1])
        self.lists = None

    def levels(self) -> list[tuple]:
        """All paths."""
        out, states = [], np.array([self.root])
        for _ in range(WORDS):
            begin = self.begins[states]
            n = self.ends[states] - begin
            arc = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
            out.append((np.repeat(np.arange(len(states)), n), self.labels[arc], self.weights[arc]))
            states = self.targets[arc]
        return out

    def weight(self, words: list[bytes]) -> int:
        """The weight at the end of a path; 0 where there is none."""
        if self.lists is None:
            self.lists = [x.tolist() for x in (self.begins, self.ends, self.labels, self.targets, self.weights)]
        begins, ends, labels, targets, weights = self.lists
        state, found = self.root, 0
        for word in words:
            label, end = bisect_left(self.words, word), ends[state]
            arc = bisect_left(labels, label, begins[state], end)
            if label == len(self.words) or self.words[label] != word or arc == end or labels[arc] != label:
                return 0
            found, state = weights[arc], targets[arc]
        return found


class Ranges:
    """Where n-grams go: a range of a language's sorted n-grams, then a slot by hash."""

    def __init__(self, keys: list[tuple[str, tuple]], wanted: int):
        self.slots = max(1, -(-wanted // MAX_CUTS))
        n = min(wanted, MAX_CUTS)
        taken = {keys[len(keys) * i // n] for i in range(1, n)} if keys else set()
        self.cuts: dict[str, list[tuple]] = {lang: [] for lang, _ in keys}
        for lang, words in sorted(taken):
            self.cuts[lang].append(words)
        self.first, total = {}, 0
        for lang in sorted(self.cuts):
            self.first[lang] = total
            total += len(self.cuts[lang]) + 1
        self.rest = total  # languages that no sampled text has
        self.count = (total + 16) * self.slots

    def start(self, lang: str) -> int:
        return self.first[lang] if lang in self.first else self.rest + zlib.crc32(lang.encode()) % 16

    def of(self, lang: str, words: list[bytes]) -> int:
        """The range of an n-gram."""
        h = 0
        for w in words:
            h = (h * 1_000_003 + zlib.crc32(w)) % (1 << 64)
        return (self.start(lang) + bisect_right(self.cuts.get(lang, []), tuple(words))) * self.slots + h % self.slots

    def parts(self, lang: str, levels: list[tuple], words: list[bytes]):
        """(range, levels) of what a shard has; labels count ``words`` from 1."""
        before, first = [0] * WORDS, self.start(lang)
        cuts = self.cuts.get(lang, [])
        for n in range(len(cuts) + 1):
            if n < len(cuts):
                at = [bisect_left(words, w) for w in cuts[n]]
                ends = bounds(levels, [(i + 1, i < len(words) and words[i] == w) for i, w in zip(at, cuts[n], strict=True)])
            else:
                ends = [len(x[0]) for x in levels]
            if ends != before:
                own = sliced(levels, before, ends)
                if self.slots == 1:
                    yield first + n, own
                else:
                    yield from ((((first + n) * self.slots + s), part) for s, part in self._by_slot(own, words))
            before = ends

    def _by_slot(self, levels: list[tuple], words: list[bytes]):
        crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        h, slots = np.zeros(1, np.uint64), []
        for parent, label, _ in levels:
            h = h[parent] * np.uint64(1_000_003) + crc[label - 1]
            slots.append(h % np.uint64(self.slots))
        for s in range(self.slots):
            part = restricted(levels, [(x == s) & (w > 0) for x, (_, _, w) in zip(slots, levels, strict=True)])
            if len(part[0][0]):
                yield s, part


def _row(at: int, lang: str, levels: list[tuple], words: list[bytes], base: int) -> tuple:
    """A part's row; its labels become places in its own sorted words, of which ``base`` is the first label."""
    used = np.unique(np.concatenate([x[1] for x in levels]))
    own = [(p, np.searchsorted(used, label), w) for p, label, w in levels]
    return at, lang, *built(own), b"\n".join([words[i] for i in (used - base).tolist()])


def _batches(rows, more: tuple[str, ...] = ()):
    """Record batches of rows of PART, few at once."""
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * len(more)]
    held: list[tuple] = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=[*COLUMNS, *more])

    for row in rows:
        held.append(row)
        if len(held) == 64:
            yield made()
            held = []
    if held:
        yield made()


class _Numbers(dict):
    """Words numbered from 1 as they come; ``BREAK`` is 0."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _shards(texts: DataFrame, ranges: Ranges) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(ranges)  # at most MAX_CUTS n-grams

    def rows(batches):
        held: dict[str, list] = {}
        number, n = _Numbers({BREAK: 0}), 0

        def counts():
            words = sorted(number.keys() - {BREAK})
            rank = np.zeros(len(number), np.int64)
            rank[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(1, len(words) + 1)
            for lang, own in held.items():
                levels = counted(rank[np.concatenate(own)], len(words) + 1)
                for at, part in shared.value.parts(lang, levels, words):
                    yield _row(at, lang, part, words, 1)

        for batch in pieces(batches):
            for lang, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                found = tokens(text)
                found.append(BREAK)
                held.setdefault(lang, []).append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                n += len(found)
                if n >= SHARD:
                    yield from counts()
                    held, number, n = {}, _Numbers({BREAK: 0}), 0
        yield from counts()

    return texts.mapInArrow(lambda b: _batches(rows(b)), PART)


class _Union:
    def __init__(self):
        self.number, self.parts, self.arcs = {}, [], 0

    def add(self, row: dict) -> None:
        part = Automaton(row)
        at = np.array([self.number.setdefault(w, len(self.number)) for w in part.words], np.int64)
        self.parts.append([(p, at[label], w) for p, label, w in part.levels()])
        self.arcs += sum(len(p) for p, _, _ in self.parts[-1])
        if self.arcs > UNITE and len(self.parts) > 1:
            self.added()

    def added(self) -> list[tuple]:
        self.parts = [united(self.parts, len(self.number) + 1)]
        self.arcs = sum(len(p) for p, _, _ in self.parts[0]) // 2  # what stays counts less, so that it is not added again with each part
        return self.parts[0]

    def frequent(self, least: int) -> tuple[list[tuple], list[bytes], int]:
        """(levels, words, words counted), with what occurs ``least`` times, in sorted order."""
        levels = self.added()
        kept = restricted(levels, [w >= least for _, _, w in levels])
        names = list(self.number)
        used = np.unique(np.concatenate([x[1] for x in kept]))
        words = sorted(names[i] for i in used.tolist())
        rank = np.zeros(len(names), np.int64)
        rank[[self.number[w] for w in words]] = np.arange(len(words))
        return united([[(p, rank[label], w) for p, label, w in kept]], len(words) + 1), words, int(levels[0][2].sum())


def _sampled(texts: DataFrame, size: int) -> Ranges:
    """Ranges of about RANGE_BYTES of text each, by n-grams at every so many words of sampled texts."""
    wanted = -(-size // RANGE_BYTES)
    keys = min(wanted, MAX_CUTS) * KEYS_A_RANGE
    share = min(1.0, keys * WORDS_A_KEY * 6 / max(size, 1))

    def every(batches):
        for batch in pieces(batches):
            for lang, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                found = [w for w in tokens(text) if w != BREAK]
                cuts = [b"\n".join(found[at : at + WORDS]) for at in range(len(found) % WORDS_A_KEY, len(found), WORDS_A_KEY)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cuts), pa.string()), pa.array(cuts, pa.binary())], names=["lang", "key"])

    if wanted <= 1:
        return Ranges([], 1)
    rows = texts.sample(share, seed=7).mapInArrow(every, "lang string, key binary").distinct().collect()  # KEYS_A_RANGE keys a range, of at most MAX_CUTS
    return Ranges(sorted((r.lang, tuple(bytes(r.key).split(b"\n"))) for r in rows), wanted)


def _questions(automata: DataFrame, ranges: Ranges) -> DataFrame:
    """``(lang, phrase, m, a, k, rest, part, range)``: both parts of every cut of every frequent phrase, and where to look them up."""
    shared = automata.sparkSession.sparkContext.broadcast(ranges)

    def asked(row):
        own, texts = Automaton(row), [()]
        for m, (parent, label, weight) in enumerate(own.levels(), 1):
            texts = [texts[p] + (own.words[x],) for p, x in zip(parent.tolist(), label.tolist(), strict=True)]
            for words, a in zip(texts, weight.tolist(), strict=True):
                if a and m > 1:
                    for k in range(1, m):
                        for rest, part in ((False, words[:k]), (True, words[k:])):
                            yield row["lang"], b" ".join(words).decode(), m, a, k, rest, b" ".join(part).decode(), shared.value.of(row["lang"], part)

    def run(batches):
        names, kinds = ["lang", "phrase", "m", "a", "k", "rest", "part", "range"], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
        for batch in batches:
            for row in batch.to_pylist():
                made = list(asked(row))
                for at in range(0, len(made), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[at : at + 4096], strict=True), kinds, strict=True)], names=names)

    return automata.select(*COLUMNS).mapInArrow(run, "lang string, phrase string, m int, a long, k int, rest boolean, part string, range int")


def _answered(questions: DataFrame, automata: DataFrame) -> DataFrame:
    """Questions with ``f``, the count of the part, each run through the automaton of its range."""
    copies = questions.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / LOOKUPS).cast("int").alias("copies"))
    copies = stage(copies, "phrase-copies")  # one row a range
    asked = questions.join(broadcast_if_small(copies), "range").withColumn("copy", F.expr("int(pmod(xxhash64(phrase, k), copies))")).drop("copies")
    held = automata.select(*COLUMNS).join(broadcast_if_small(copies), "range").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {row["lang"]: Automaton(row) for row in right.to_pylist()}
        known: dict[tuple, int] = {}
        found = []
        for key in zip(left.column("lang").to_pylist(), left.column("part").to_pylist(), strict=True):
            if key not in known:
                known[key] = own[key[0]].weight(key[1].encode().split(b" "))
            found.append(known[key])
        return left.select(["lang", "phrase", "m", "a", "k", "rest"]).append_column("f", pa.array(found, pa.int64()))

    return asked.groupBy("range", "copy").cogroup(held.groupBy("range", "copy")).applyInArrow(compose, "lang string, phrase string, m int, a long, k int, rest boolean, f long")


def scored(answers: DataFrame) -> DataFrame:
    """``(lang, phrase, m, a, l, r, score)`` by the cut of the least score, then of the fewest words."""
    cut = lambda k, rest: F.max(F.when((F.col("k") == k) & (F.col("rest") == rest), F.col("f")))
    rows = answers.groupBy("lang", "phrase", "m", "a").agg(*(cut(k, rest).alias(f"{'r' if rest else 'l'}{k}") for k in range(1, WORDS) for rest in (False, True)))
    score = lambda k: F.expr(f"cast(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l{k} as decimal(20, 0)) + cast(r{k} as decimal(20, 0))) as long)")
    cuts = F.array(*(F.when(F.col("m") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, WORDS)))
    return rows.withColumn("best", F.array_min(F.array_compact(cuts))).select("lang", "phrase", "m", "a", "best.l", "best.r", "best.score")


def uncovered(rows: DataFrame, share: int) -> DataFrame:
    """Rows whose words lie in no longer phrase that has ``share`` per cent of their count or more."""
    words = F.split("phrase", " ")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))))
    longer = rows.where("m > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = F.expr(f"cast(most as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {share}")
    return rows.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("most")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two to four words with a count of ``least``."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = _sampled(texts, size)
    dealt = _shards(texts, ranges).repartitionById(ranges.count, F.col("range"))

    def unite(batches):
        own: dict[tuple, _Union] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own.setdefault((row["range"], row["lang"]), _Union()).add(row)
        for (at, lang), union in own.items():
            levels, words, n = union.frequent(least)
            yield *_row(at, lang, levels, words, 0), n

    automata = stage(dealt.mapInArrow(lambda b: _batches(unite(b), ("n",)), PART + ", n long"), "phrase-automata")
    rows = stage(scored(_answered(stage(_questions(automata, ranges), "phrase-parts"), automata)), "phrases")
    order = (F.desc("score"), F.desc("a"), "phrase")
    best = uncovered(rows, share).withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = automata.groupBy("lang").agg(F.sum("n").alias("n"))  # one row a language
    return best.join(broadcast_if_small(stage(n, "phrase-words")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocation_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM p, (VALUES (1), (2), (3), (4)) AS s(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
x AS (SELECT k.lang, k.m, k.phrase, k.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k + 1 : k.m], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
s AS (SELECT lang, a, array_to_string(w[i : i + z - 1], ' ') AS phrase FROM c, (VALUES (2), (3)) AS z(z), (VALUES (1), (2), (3)) AS i(i) WHERE z < m AND i + z - 1 <= m),
d AS (SELECT lang, phrase, max(a) AS most FROM s GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
