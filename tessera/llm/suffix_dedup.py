"""Repeated byte strings, from longest-previous-factor arrays over suffixes that share an anchor.

A string of ``length`` bytes that occurs twice holds the same anchor in both places: the leftmost
of its 145-byte substrings with the least rolling hash. So each start of such a string belongs to
one anchor, starts of one anchor form a run, and only runs of the same anchor need be compared.
Copies of a run's whole context (64 bits of digest besides the anchor's hash) are merged before
anything is moved: the second one and later ones repeat it whole. Contexts that differ are sent on, once each.
Where a text goes on and on with a short period, a context follows itself at every period: such a stretch is
one row with a number of times from the start on, so rows grow with the stretches, not with their lengths.

Those are brought together by anchor and laid end to end. Their suffix array, by prefix doubling up to
``length`` bytes, has the common prefixes of neighbours; previous and next smaller positions in suffix
order give each start its longest previous factor, and the same over positions turned round its longest
following one. With ``keep="first"`` the starts whose previous factor reaches ``length`` are repeats;
with ``keep="none"`` those with either.

An anchor with more than ``most`` distinct contexts (a very common line) is divided by a second, longer
anchor within its contexts, then by whole strings of ``length``, each a bounded task of its own. The rows of
that grow with the contexts, and strings that are equal share every anchor, so no match is lost.

With ``words``, a string is that many words instead, however they are spaced: each text is compared as
the 48-bit hashes of its words end to end, and only ranges of that many whole words count.

Defined results: null text counts as empty; texts shorter than ``length`` stay as they are; very long texts
are hashed in slices, and the contexts and ranges listed for one text are fewer than its bytes; of equal strings the
first is that of the smallest doc_id, then place; rows that repeat doc_id and text repeat each other, but share
one result, so with ``keep="first"`` each is treated as the first; null doc_ids come last; an empty table gives
an empty result; other columns are kept or ignored as they are.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, id_ranks, pieces, release, stage, table, unstage, values

LENGTH, GRAM = 400, 145
WORD = 6  # bytes that stand for a word
BUFFER = 1 << 19  # bytes hashed at once
SORTED = 1 << 19  # bytes of contexts sorted at once, or one anchor's
MOST = 512  # distinct contexts of an anchor compared at once

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_table = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        made = np.full(max(n, BUFFER + LENGTH), base, np.uint64)
        made[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(made)
    return have[:n]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each substring of ``gram`` bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_table[data] * _power(_BASE, n), out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _power(_INVERSE, n - gram + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first start, last start, anchor position) of each run, in texts cut at ``bounds``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = _gram_hashes(data, gram)
    # The upper half decides, then the place: the leftmost of equal ones.
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = (_window_min(keyed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(least) + 1, np.int32)
    starts, ends = bounds[:-1], bounds[1:] - length + 1
    real = ends > starts
    np.add.at(inside, starts[real], 1)
    np.add.at(inside, ends[real], -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    at = starts[real]
    first[at[at < len(first)]] = True
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    anchor = least[lo]
    return h[anchor], lo, hi, anchor


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``length`` bytes: equal exactly where those are.

    Prefix doubling; what reaches over the end of ``data`` sorts before all else.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | (padded[i : i + n] + np.uint64(1)) * (np.arange(n) + i < n)
    rank, have = _dense(key), 7
    while have < length:
        step = min(have, length - have)
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        rank = _dense(rank.astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64))
        have += step
    return rank


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.concatenate([[0], (key[order[1:]] != key[order[:-1]]).astype(np.int64)])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def previous_factors(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order, its longest common prefix with one at a smaller place.

    ``places`` are those of the suffixes, ``common`` the prefix each shares with the one before it in
    suffix order; what is too short to matter may count as 0. The longest previous factor is found at the previous
    or the next smaller place in that order.
    """
    def before(place, shared):
        at, least = np.arange(len(place)) - 1, shared.copy()
        least[:1] = 0
        open_ = np.flatnonzero((least > 0) & (place[at] > place))
        while len(open_):  # all between at[i] and i have larger places, so the search goes on where at[i]'s ended
            over = at[open_]
            least[open_], at[open_] = np.minimum(least[open_], least[over]), at[over]
            open_ = open_[(least[open_] > 0) & (place[at[open_]] > place[open_])]
        return least

    return np.maximum(before(places, common), before(places[::-1], np.concatenate([common[:1], common[:0:-1]]))[::-1])


def repeated_starts(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int, keep: str = "none") -> np.ndarray:
    """Which of ``starts`` begin a string of ``length`` bytes that begins at another of their group too.

    ``starts`` are in order of position; with ``keep="first"``, only one before counts.
    """
    rank = suffix_ranks(data, length)[starts] * (int(groups[-1]) + 1) + groups
    order = np.argsort(rank, kind="stable")  # the suffix array of the starts, of equal strings by position
    common = np.concatenate([[0], np.where(rank[order[1:]] == rank[order[:-1]], length, 0)])
    factor = previous_factors(order, common)
    if keep != "first":
        factor = np.maximum(factor, previous_factors(len(order) - 1 - order, common))
    out = np.zeros(len(starts), bool)
    out[order] = factor >= length
    return out


def word_bytes(body: bytes) -> bytes:
    """The hashes of a text's words, ``WORD`` bytes each."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, body.split()), np.uint64)
    return hashes.view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()


def _word_spans(body: bytes, spans) -> list[dict]:
    """Ranges of words as ranges of bytes, each with the white space that follows it unless it ends the text."""
    places = [m.span() for m in re.finditer(rb"\S+", body)]
    return [{"from": places[s["from"]][0], "to": places[s["to"]][0] if s["to"] < len(places) else places[-1][1]} for s in spans]


def _row_id(key: str, body: Column) -> Column:
    """128 bits; rows that repeat key and text share them."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.col(key).isNull().cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), body)))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("__row", _row_id(key, body)).withColumn("__body", body.cast("binary"))


def _anchors(rows: DataFrame, length: int, gram: int, by_word: bool = False) -> DataFrame:
    """``(h, d, row, doc, p, before, after, times)``: p is the anchor, before and after the bytes of its context on both sides.

    A context that follows itself ``times`` over, each one ``before + after - length + 1`` bytes on (its starts), is listed by its first.
    ``rows`` are ``(of, row, doc, at, bytes)``: bytes that begin at place ``at`` of a row; ``of`` sets apart the anchors of one group.
    """
    def made(parts, places, names, rows_, docs_):
        data = np.concatenate(parts)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        h, lo, hi, anchor = runs(data, bounds, length, gram)
        if not len(h):
            return
        which = np.searchsorted(bounds, lo, "right") - 1
        raw = memoryview(data)
        before, after = anchor - lo, hi + length - anchor
        digest = np.fromiter(
            (xxhash.xxh3_64_intdigest(raw[a:b], s) for a, b, s in zip(lo.tolist(), (hi + length).tolist(), (before * 4096 + hi - lo).tolist(), strict=True)),
            np.uint64, len(lo),
        )
        h = (h ^ np.asarray(names, np.int64).view(np.uint64)[which]) * np.uint64(0x9E3779B97F4A7C15)
        p = anchor - bounds[which] + np.asarray(places)[which]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (digest[1:] != digest[:-1]) | (which[1:] != which[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(h)))
        h, digest, which, p, before, after = (x[first] for x in (h, digest, which, p, before, after))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(h.view(np.int64)), pa.array(digest.view(np.int64)), pa.array([rows_[i] for i in which], pa.binary()),
                pa.array([docs_[i] for i in which], pa.int64()), pa.array(p), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)),
                pa.array(times.astype(np.int32)),
            ],
            names=["h", "d", "row", "doc", "p", "before", "after", "times"],
        )

    def run(batches):
        parts, places, names, rows_, docs_, held = [], [], [], [], [], 0
        for batch in batches:
            for of, row, doc, place, body in zip(*map(values, batch.columns), strict=True):
                body = word_bytes(body) if by_word else body
                for at in range(0, max(1, len(body) - length + 1), BUFFER):
                    part = body[at : at + BUFFER + length - 1]
                    if len(part) < length:
                        continue
                    parts.append(np.frombuffer(part, np.uint8))
                    places.append(place + at)
                    names.append(of)
                    rows_.append(row)
                    docs_.append(doc)
                    held += len(part)
                    if held >= BUFFER:
                        yield from made(parts, places, names, rows_, docs_)
                        parts, places, names, rows_, docs_, held = [], [], [], [], [], 0
        if held:
            yield from made(parts, places, names, rows_, docs_)
        release()

    return rows.select("of", "row", "doc", "at", "bytes").mapInArrow(run, "h long, d long, row binary, doc long, p long, before int, after int, times int")


def _cut_contexts(rows: DataFrame, wanted: DataFrame, by_word: bool = False) -> DataFrame:
    """The bytes of the contexts that ``wanted`` lists by row."""
    listed = wanted.groupBy("row").agg(F.collect_set(F.struct("h", "doc", "p", "before", "after")).alias("list"))
    listed = stage(listed, "lpf-listed")
    one = rows.select(F.col("__row").alias("row"), "__body")
    cut = F.transform("list", lambda c: F.struct(
        *(c[x].alias(x) for x in ("h", "doc", "p", "before")),
        F.substring(F.col("__body"), (c["p"] - c["before"] + 1).cast("int"), c["before"] + c["after"]).alias("bytes"),
    ))

    def encode(batches):
        for batch in pieces(batches):
            made = pa.array(map(word_bytes, values(batch.column("__body"))), pa.binary())
            cols = [made if n == "__body" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    found = one.join(broadcast_if_small(listed, F.size("list")), "row")
    if by_word:
        found = found.mapInArrow(encode, found.schema)
    return found.select("row", F.explode(cut).alias("c")).select("row", "c.*")


def _compare(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """``(row, doc, p, from, to)``: bytes of compared contexts that repeats cover."""

    def found(groups):
        """groups: lists of rows (row, doc, p, before, bytes) that share an anchor."""
        flat = [r for g in groups for r in sorted(g, key=lambda r: (r[1] is None, r[1] or 0, r[0], r[2]))]
        data = np.concatenate([np.frombuffer(r[4], np.uint8) for r in flat])
        at = np.concatenate([[0], np.cumsum([len(r[4]) for r in flat])])
        counts = np.array([len(r[4]) - length + 1 for r in flat])
        which = np.repeat(np.arange(len(flat)), counts)
        starts = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + at[which]
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        hit = repeated_starts(data, starts, group[which], length, keep)
        if not hit.any():
            return
        which, starts = which[hit], starts[hit] - at[which[hit]]
        new = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(starts) != 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
        origin = np.array([r[2] - r[3] for r in flat])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([flat[i][0] for i in which[first]], pa.binary()),
                pa.array(origin[which[first]] + starts[first]), pa.array(origin[which[first]] + starts[last] + length),
            ],
            names=["row", "from", "to"],
        )

    def run(batches):
        groups, group, held, now, seen = [], [], 0, None, set()
        for batch in batches:
            for r in zip(*map(values, batch.columns), strict=True):
                if r[0] != now:
                    if len(group) > 1:
                        groups.append(group)
                        held += sum(len(x[4]) for x in group)
                    group, now, seen = [], r[0], set()
                    if held >= SORTED:
                        yield from found(groups)
                        groups, held = [], 0
                place = r[1], r[3], r[4]
                if place not in seen:  # rows that repeat doc_id and text bring a context more than once
                    seen.add(place)
                    group.append(r[1:])
        if len(group) > 1:
            groups.append(group)
        if groups:
            yield from found(groups)
        release()

    dealt = contexts.select("h", "row", "doc", "p", "before", "bytes").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "row binary, `from` long, `to` long")


def _joined(spans: DataFrame) -> DataFrame:
    """``(row, from, to)``: ranges of a row that overlap or touch as one, so that what is listed for a row grows with what is apart in it."""
    by = Window.partitionBy("row").orderBy("from", "to")
    end = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (end.isNull() | (F.col("from") > end)).cast("long"))
    spans = spans.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("row", "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run")


def repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", gram: int = GRAM, most: int = MOST, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """``(__row, spans)``: for rows with repeats, the byte ranges (from, to) to remove, by start and apart from each other.

    With ``words``, strings of that many words are looked for, and the ranges count words.
    """
    rows = _keyed(docs, key, text)
    if words:
        length, gram = words * WORD, words * WORD * GRAM // LENGTH
    zero = F.lit(0).cast("long")
    ranks, doc = id_ranks(rows, key, "__rank"), F.col(key).cast("long")
    if ranks is not None:
        ranks, doc = ranks.withColumnRenamed(key, "__own"), F.col("__rank")
        rows = rows.join(ranks, F.col(key) == F.col("__own"), "left")
    texts = rows.select(zero.alias("of"), F.col("__row").alias("row"), doc.alias("doc"), zero.alias("at"), F.col("__body").alias("bytes"))
    anchors = stage(_anchors(texts, length, gram, bool(words)), "lpf-anchors")
    step = F.col("before") + F.col("after") - F.lit(length - 1)
    order = F.struct(F.col("doc").isNull().alias("x"), F.col("doc"), F.col("row"), F.col("p"), F.col("before"), F.col("after"))
    found = []
    for longer in ((gram + length) // 2, length, None):
        many = anchors.groupBy("h").agg(F.sum("times").alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).where("n > 1")
        many = stage(many.select("h", (F.col("a") != F.col("b")).alias("differ")), "lpf-many")
        shared = stage(anchors.join(many, "h"), "lpf-shared")
        unstage(anchors, many)
        same = stage(shared.groupBy("h", "d", "differ").agg(F.sum("times").alias("n"), F.min(order).alias("one")), "lpf-same")
        whole = shared.join(same.where("n > 1").select("h", "d", "one"), ["h", "d"])
        start, end = F.col("p") - F.col("before"), F.col("p") + F.col("after") + (F.col("times") - 1) * step
        if keep == "first":
            # Rows that repeat doc_id and text share a row number, and stay or go together, as one. Of a stretch the first context stays.
            kept = (F.col("row") == F.col("one.row")) & (F.col("p") == F.col("one.p"))
            whole, start = whole.where(~kept | (F.col("times") > 1)), start + F.when(kept, step).otherwise(0)
        whole = whole.select("row", start.alias("from"), end.alias("to"))
        found.append(stage(whole, "lpf-whole"))
        distinct = same.where("differ").select("h", "one.*")
        hot = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (most if longer else 1 << 62)).select("h")
        hot = broadcast_if_small(stage(hot, "lpf-hot"))
        found.append(stage(_compare(_cut_contexts(rows, distinct.join(hot, "h", "left_anti"), bool(words)), length, keep), "lpf-partial"))
        if hot.isEmpty():
            break
        parts = _cut_contexts(rows, distinct.join(hot, "h", "left_semi"), bool(words))
        parts = parts.select(F.col("h").alias("of"), "row", "doc", (F.col("p") - F.col("before")).alias("at"), "bytes")
        if words:
            parts = stage(parts, "lpf-parts")  # a task with two Python operators leaves two workers, which fill tables in later stages
        anchors = stage(_anchors(parts, length, longer), "lpf-anchors")
        unstage(shared, same, parts)
    spans = reduce(DataFrame.unionByName, found)
    if words:
        spans = spans.select("row", F.ceil(F.col("from") / WORD).alias("from"), F.floor(F.col("to") / WORD).alias("to")).where(F.col("to") - F.col("from") >= words)
    spans = _joined(spans).groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("found"))
    spans = stage(spans.select(F.col("row").alias("__row"), F.array_sort("found").alias("spans")), "lpf-spans")
    unstage(shared, same, *found)
    return spans


def _kept(body: bytes, spans, whole_characters: bool):
    """(removed bytes, removed runs, remaining bytes)."""
    parts, at, removed, n = [], 0, 0, 0
    end = None
    joined = []
    for s in spans or ():
        if end is not None and s["from"] <= end:
            end = joined[-1][1] = max(end, s["to"])
        else:
            joined.append([s["from"], s["to"]])
            end = s["to"]
    for a, b in joined:
        if whole_characters:
            while a < b and body[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
                b -= 1
        if b > a:
            parts.append(body[at:a])
            at, removed, n = b, removed + b - a, n + 1
    parts.append(body[at:])
    return removed, n, b"".join(parts)


def measure(docs: DataFrame, length: int = LENGTH, keep: str = "none", key: str = "doc_id", text: str = "text", with_text: bool = False, **more) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` of each document; ``n_bytes`` is the length of the whole text.

    ``with_text`` adds ``text``, what is left as :func:`remove` leaves it: null stays null, a character cut in two stays whole.
    """
    found = repeats(docs, length, keep, key=key, text=text, **more)
    rows = _keyed(docs, key, text).withColumn("__null", F.col(text).isNull()).select(key, "__row", "__body", "__null")
    rows = rows.join(broadcast_if_small(found, F.size("spans")), "__row", "left")

    def run(batches):
        for batch in pieces(batches):
            made, texts = [], []
            for body, spans, null in zip(*map(values, batch.columns[1:]), strict=True):
                removed, n, left = _kept(body, spans, False)
                made.append((len(body), removed, n, hashlib.sha256(left).hexdigest()))
                if with_text:
                    texts.append(None if null else _kept(body, spans, True)[2] if n else body)
            cols = list(zip(*made, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary())] * with_text, names=names)

    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text
    made = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text binary" * with_text
    out = rows.select(key, "__body", "spans", "__null").mapInArrow(run, made)
    return out.withColumn("text", F.col("text").cast("string")) if with_text else out  # bytes that are no UTF-8 pass as they are


def remove(docs: DataFrame, length: int = LENGTH, keep: str = "first", key: str = "doc_id", text: str = "text", words: int | None = None, **more) -> DataFrame:
    """``docs`` with repeats of ``length`` bytes, or of ``words`` words, cut out of the text.

    A character cut in two stays whole; ``n_chars`` follows.
    """
    found = repeats(docs, length, keep, key=key, text=text, words=words, **more)
    # Other columns travel in a struct, so that none clashes with what is added.
    rows = docs.select(F.struct("*").alias("doc"), _row_id(key, F.coalesce(F.col(text), F.lit(""))).alias("__row"))
    names = docs.columns
    rows = rows.join(broadcast_if_small(found, F.size("spans")), "__row", "left").select(*(F.col("doc").getField(n).alias(f"c{i}") for i, n in enumerate(names)), "spans")
    at = names.index(text)

    def run(batches):
        for batch in pieces(batches):
            texts = [
                t if not s else _kept(t.encode(), _word_spans(t.encode(), s) if words else s, True)[2].decode()
                for t, s in zip(values(batch.column(at)), values(batch.column(len(names))), strict=True)
            ]
            cols = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out


def op9_suffix_lpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"), with_text=True)
