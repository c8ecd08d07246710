"""SimHash near-duplicates, found with a Gray-order hierarchical index.

Fingerprints are bits over word shingles. Equal ones are merged first. Distinct ones are dealt out
into buckets of equal keys, and each bucket is indexed: its fingerprints are sorted by Gray rank, and
nodes of up to ``FANOUT`` are built bottom up, each holding the masked bit pattern that all its members
share. A search walks all queries down together, adds up the bits that differ at each level, and drops
a node with its members once the sum is over the limit, or once the query and all members are known
to be connected. Every link comes from that search; a bucket gives a spanning forest, never its pairs.

``near_duplicates`` links 64-bit fingerprints within three differing bits. Such two agree on at least
two of five blocks, so buckets by the ten block pairs (about 25 bits each) miss no link.

``keep_one`` removes documents whose sets of ``words``-word shingles have a Jaccard similarity of
``least`` or more. At 0.8 about 15 of 100 bits differ, which 64 bits and exact blocks cannot tell
from chance, so it takes 256 bits: buckets by keys of sampled bits, as many keys as leave a pair at
``least`` unmet with a chance of ``MISS``; the index over the first 128 bits, with a limit four standard
deviations above what is expected; then the shingles of what it links are counted exactly. The
length of a key follows the number of fingerprints, so that buckets stay small at every size.

Buckets and groups over a fixed size are cut by hash, see ``grouped``; no link is lost.

Defined results: null text counts as empty; no words give fingerprint zero, fewer words than a
shingle use the whole sequence; texts of any length are read whole, in slices; equal fingerprints are
always linked, whatever the keys; repeated rows each get a row (``keep_one``: one of several that repeat
key and text stays); a null doc_id takes part but never names a component unless it is alone, and stays
only where no other does; an empty table gives an empty result; other columns are kept or ignored as they are.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, pieces, release, stage, table, unstage, values
from tessera.llm.components import connected_components
from tessera.llm.grouped import link_groups

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK_PAIRS = tuple((i, j) for i in range(5) for j in range(i))
FANOUT = 8
FRONTIER = 1 << 17  # pairs of a query and a node looked at together, about
BUCKET = 4096  # fingerprints searched in one task at most, twice that across chunks
WORDS, LEAST, MISS, IN_A_BUCKET = 5, 0.8, 0.005, 128
SHINGLES = 1 << 19  # shingles of one candidate group compared in one task


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    ones, n = np.zeros(64, np.int64), len(tokens) - words + 1
    for at in range(0, n, 65536):
        part = tokens[at : at + 65536 + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)``: fp is the fingerprint's 64 bits as a signed long."""
    def run(batches):
        for batch in pieces(batches):
            made = np.array([fingerprint(t, words) for t in values(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Nodes over fingerprints in order of bucket and Gray rank; level 0 are the fingerprints, the top has one node a bucket.

    ``codes`` has a row of 64-bit words for each fingerprint. ``order`` tells where each came from.
    """

    def __init__(self, buckets: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((*(gray_rank(w) for w in codes.T[::-1]), buckets))
        self.codes, buckets = codes[self.order], buckets[self.order]
        new = np.concatenate([[True], buckets[1:] != buckets[:-1]])
        self.bucket = np.cumsum(new) - 1
        self.sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(new)]]))
        self.patterns, self.masks, self.last = [self.codes], [np.full_like(self.codes, ~np.uint64(0))], [np.arange(len(codes))]
        self.starts: list[np.ndarray] = [np.arange(len(codes))]  # of each node's children
        bucket = self.bucket
        while len(self.starts) == 1 or len(bucket) > len(self.sizes):
            at = np.arange(len(bucket)) - np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[bucket]
            starts = np.flatnonzero(at % fanout == 0)
            below, mask = self.patterns[-1], self.masks[-1]
            every, some = np.bitwise_and.reduceat(below, starts), np.bitwise_or.reduceat(below, starts)
            shared = ~(every ^ some) & np.bitwise_and.reduceat(mask, starts)
            self.patterns.append(every & shared)
            self.masks.append(shared)
            self.last.append(self.last[-1][np.concatenate([starts[1:], [len(bucket)]]) - 1])
            self.starts.append(starts)
            bucket = bucket[starts]

    def linked(self, queries: np.ndarray, limit: int, same=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs within ``limit`` bits, of one bucket, the member later in order.

        ``same(level, q, node)`` marks pairs of a query and a node that need no look.
        """
        q, node = queries, self.bucket[queries]
        known = np.zeros(len(q), np.uint64)
        upper = np.zeros((len(q), self.codes.shape[1]), np.uint64)
        for level in range(len(self.starts) - 1, -1, -1):
            mask = self.masks[level][node]
            known = known + np.bitwise_count((self.codes[q] ^ self.patterns[level][node]) & mask & ~upper).sum(axis=1, dtype=np.uint64)
            keep = (known <= limit) & (self.last[level][node] > q)
            if same is not None:
                keep &= ~same(level, q, node)
            q, node, known, upper = q[keep], node[keep], known[keep], mask[keep]
            if level:
                first = self.starts[level]
                n = np.concatenate([first[1:], [len(self.starts[level - 1])]])[node] - first[node]
                node = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, known, upper = (np.repeat(x, n, axis=0) for x in (q, known, upper))
        return q, node


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the members a[i] and b[i]; a label is the smallest index of its set."""
    while True:
        x, y = labels[a], labels[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return labels
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels != (up := labels[labels])).any():
            labels = up


def forest(buckets: np.ndarray, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, root) places, of the links among the fingerprints of each bucket."""
    index = GrayIndex(buckets, codes)
    labels = np.arange(len(codes))
    looked = np.cumsum(index.sizes[index.bucket])
    cuts = np.searchsorted(looked, np.arange(FRONTIER, looked[-1] + FRONTIER, FRONTIER), "right")
    at = 0
    for end in np.unique(np.maximum(cuts, 1)).tolist() + [len(codes)]:
        if end <= at:
            continue
        uniform = [labels]
        for starts in index.starts[1:]:
            low, high = np.minimum.reduceat(uniform[-1], starts), np.maximum.reduceat(uniform[-1], starts)
            uniform.append(np.where((low == high), low, -1))
        q, node = index.linked(np.arange(at, end), limit, lambda level, q, n, u=uniform: u[level][n] == u[0][q])
        labels = _merge(labels, q, node)
        at = end
    child = np.flatnonzero(labels != np.arange(len(labels)))
    return index.order[child], index.order[labels[child]]


def gray_links(limit: int, ident: str, words: tuple[str, ...]):
    """A linker for :func:`grouped.link_groups`: rows ``(bucket, pair, ident, words)`` to edges ``(a, b)``."""
    def run(batches):
        rest: list[np.ndarray] = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if rest else cols
            if len(rest[0]) >= 1 << 15:
                change = np.flatnonzero((np.diff(rest[0]) != 0) | (np.diff(rest[1]) != 0)) + 1
                if len(change):
                    yield from found([c[: change[-1]] for c in rest])
                    rest = [c[change[-1] :] for c in rest]
        if rest and len(rest[0]):
            yield from found(rest)
        release()

    def found(cols):
        new = np.concatenate([[True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)])
        bucket = np.cumsum(new) - 1
        many = np.bincount(bucket)[bucket] > 1
        if many.any():
            codes = np.stack([c[many].view(np.uint64) for c in cols[3:]], axis=1)
            a, b = forest(bucket[many], codes, limit)
            ids = cols[2][many]
            yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.int64()) for x in (a, b)], names=["a", "b"])

    def link(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("bucket", "pair", ident, *words).repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
        return dealt.mapInArrow(run, "a bigint, b bigint").where("a != b").distinct()

    return link


def link_fingerprints(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` edges over distinct ``fp`` that connect what lies within three bits, which five blocks of which two agree cover."""
    def part(block: int):
        start, width = BLOCKS[block]
        return F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << width) - 1))

    keys = [F.shiftleft(part(i), 17).bitwiseOR(F.shiftleft(part(j), 4)).bitwiseOR(F.lit(n)) for n, (i, j) in enumerate(BLOCK_PAIRS)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("bucket"), F.col("fp").alias("code"))
    return link_groups(rows, gray_links(3, "fp", ("code",)), bucket, "bucket", "fp")


def near_duplicates(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp, component, component_id)``.

    component is the smallest fingerprint and component_id the smallest key reachable over links.
    """
    marked = stage(with_fingerprints(docs, words, key, text), "simhash-fp")
    classes = stage(marked.groupBy("fp").agg(F.min(key).alias("first")), "simhash-class")
    edges = stage(link_fingerprints(classes.select("fp")), "simhash-edges")
    groups = connected_components(edges).withColumnRenamed("node", "fp")
    named = classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = stage(named.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-first")
    of_class = stage(named.join(first, "component").select("fp", "component", "component_id"), "simhash-of")
    out = marked.join(of_class, "fp").select(key, "fp", "component", "component_id")
    unstage(edges, first)
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        made = [b" ".join(tokens)] if tokens else []
    else:
        made = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(42)), np.uint64))


_SEEDS = np.random.default_rng(8).integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits in four words, over a set of shingle hashes."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(hashes), 8192):
        mixed = hashes[at : at + 8192, None] * _SEEDS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def differing(least: float) -> float:
    """The share of bits in which sets of that Jaccard similarity are expected to differ at most."""
    return math.acos(2 * least / (1 + least)) / math.pi


def key_plan(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, number of keys) for ``n`` fingerprints.

    A pair at ``least`` shares no key with a chance of ``miss``, over what the number of its differing bits may be.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(n, 1) / IN_A_BUCKET))))
    p = differing(least)
    share = np.array([math.comb(256, d) * p**d * (1 - p) ** (256 - d) for d in range(257)])
    apart = np.array([1 - math.comb(256 - d, bits) / math.comb(256, bits) for d in range(257)])
    keys = 1
    while (share * apart**keys).sum() > miss:
        keys += 1 + keys // 64
    return bits, keys


def _keyed_fingerprints(classes: DataFrame, bits: int, keys: int) -> DataFrame:
    """``(bucket, c, w0, w1)``: a row for each key of each fingerprint."""
    draw = np.random.default_rng(5)
    weights = np.zeros((256, keys))
    for k in range(keys):
        weights[draw.choice(256, bits, replace=False), k] = 2.0 ** np.arange(bits)

    def run(batches):
        for batch in batches:
            words = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            c = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(c), 2048):
                part = np.ascontiguousarray(words[at : at + 2048])
                bucket = (np.unpackbits(part.view(np.uint8), axis=1, bitorder="little") @ weights).astype(np.int64)
                bucket += np.arange(keys, dtype=np.int64) << 48
                once = [np.repeat(x, keys) for x in (c[at : at + 2048], part[:, 0], part[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (bucket.ravel(), *once)], names=["bucket", "c", "w0", "w1"])

    return classes.select("c", "w0", "w1", "w2", "w3").mapInArrow(run, "bucket bigint, c bigint, w0 bigint, w1 bigint")


def links(sets: list[np.ndarray], least: float = LEAST) -> tuple[list[int], list[int]]:
    """(member, root) index pairs that connect all sets, none of them empty, that links connect."""
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    members, roots = [], []
    left, inside = np.arange(len(sets)), flat
    marked = np.zeros(len(names), bool)
    while len(left):
        root = left[0]
        inside, left = inside[sizes[root] :], left[1:]
        open_ = [root]
        while open_ and len(left):
            p = open_.pop()
            mine = flat[bounds[p] : bounds[p + 1]]
            marked[mine] = True
            n = sizes[left]
            shared = np.add.reduceat(marked[inside], np.cumsum(n) - n, dtype=np.int64)
            marked[mine] = False
            near = shared >= least * (n + sizes[p] - shared) - 1e-6
            if near.any():
                found = left[near].tolist()
                open_ += found
                members += found
                roots += [int(root)] * len(found)
                inside, left = inside[np.repeat(~near, n)], left[~near]
    return members, roots


def _with_row(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, text, F.xxhash64(key, F.coalesce(F.col(text), F.lit(""))).alias("__row"))


def _sets(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """``(key, row, c, n, w0 .. w3)``: the digest, size and fingerprint of a text's set."""
    def run(batches):
        for batch in pieces(batches):
            made = [shingles(t, words) for t in values(batch.column(2))]
            wide = np.array([wide_fingerprint(m) for m in made], np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([xxhash.xxh3_64_intdigest(m.tobytes()) - (1 << 63) for m in made], pa.int64()),
                    pa.array(map(len, made), pa.int64()), *(pa.array(wide[:, i], pa.int64()) for i in range(4)),
                ],
                names=[key, "row", "c", "n", "w0", "w1", "w2", "w3"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = _with_row(docs, key, text).select(key, "__row", text)
    return rows.mapInArrow(run, f"`{key}` {kind}, row bigint, c bigint, n bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")


def candidates(classes: DataFrame, least: float = LEAST, bucket: int = BUCKET) -> DataFrame:
    """``(c, component)`` of the distinct sets that the index links, directly or over others."""
    bits, keys = key_plan(classes.count(), least)
    p = differing(least)
    limit = math.ceil(128 * p + 4 * math.sqrt(128 * p * (1 - p)))
    rows = _keyed_fingerprints(classes.where("n > 0"), bits, keys)
    edges = stage(link_groups(rows, gray_links(limit, "c", ("w0", "w1")), bucket, "bucket", "c"), "simhash-may")
    found = stage(connected_components(edges).select(F.col("node").alias("c"), "component"), "simhash-candidates")
    unstage(edges)
    return found


def _linked(docs: DataFrame, classes: DataFrame, words: int, least: float, most: int, key: str, text: str) -> DataFrame:
    """``(a, b)``: edges over set digests that connect what exact counts of shared shingles link."""
    wanted = stage(candidates(classes, least).join(classes.select("c", "n", "row"), "c"), "simhash-wanted")
    texts = _with_row(docs, key, text).select(F.col("__row").alias("row"), F.col(text).alias("text"))

    def cut(batches):
        for batch in pieces(batches):
            made = [shingles(t, words).tobytes() for t in values(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["component", "c", "pairs", "hashes"])

    def run(batches):
        group, now = {}, None
        for batch in batches:
            for component, pair, c, hashes in zip(*map(values, batch.columns), strict=True):
                if (component, pair) != now:
                    yield from joined(group)
                    group, now = {}, (component, pair)
                group[c] = hashes  # rows that repeat key and text come more than once
        yield from joined(group)

    def joined(group):
        if len(group) > 1:
            ids = list(group)
            a, b = links([np.frombuffer(group[c], np.uint64) for c in ids], least)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in x], pa.int64()) for x in (a, b)], names=["a", "b"])

    def link(dealt: DataFrame) -> DataFrame:
        listed = stage(dealt.groupBy("component", "c", "row").agg(F.collect_list("pair").alias("pairs")), "simhash-listed")
        sets = texts.join(broadcast_if_small(listed), "row").select("component", "c", "pairs", "text")
        sets = sets.mapInArrow(cut, "component bigint, c bigint, pairs array<bigint>, hashes binary")
        sets = sets.select("component", F.explode("pairs").alias("pair"), "c", "hashes")
        return sets.repartition("component", "pair").sortWithinPartitions("component", "pair").mapInArrow(run, "a bigint, b bigint")

    return link_groups(wanted, link, most, "component", "c", "n")


def keep_one(docs: DataFrame, words: int = WORDS, least: float = LEAST, most: int = SHINGLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest key, of several such rows any one."""
    marked = stage(_sets(docs, words, key, text), "simhash-sets")
    order = F.struct(F.col(key).isNull().alias("x"), F.col(key).alias("key"), "row")
    classes = marked.groupBy("c").agg(*(F.first(x).alias(x) for x in ("n", "w0", "w1", "w2", "w3")), F.min("row").alias("row"))
    classes = stage(classes, "simhash-classes")
    edges = stage(_linked(docs, classes, words, least, most, key, text), "simhash-edges")
    groups = stage(connected_components(edges).withColumnRenamed("node", "c"), "simhash-groups")
    unstage(classes, edges)
    rows = marked.select(key, "row", "c").join(groups, "c", "left").withColumn("component", F.coalesce("component", "c"))
    rows = stage(rows.select(key, "row", "component"), "simhash-rows")
    first = rows.groupBy("component").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stage(first.select("component", F.col("one.row").alias("one")), "simhash-first")
    listed = rows.join(first, "component").groupBy("row").agg(F.max(F.col("row") == F.col("one")).alias("stays"), F.count(F.lit(1)).alias("n"))
    # Only rows that go, or stay once of several that repeat key and text, are joined.
    listed = stage(listed.where("not stays or n > 1").select(F.col("row").alias("__row"), "stays"), "simhash-listed")
    unstage(marked, groups, rows, first)
    # Other columns travel in a struct, so that none clashes with what is added.
    numbered = docs.select(F.struct("*").alias("doc"), F.xxhash64(key, F.coalesce(F.col(text), F.lit(""))).alias("__row"))
    alone = numbered.join(broadcast_if_small(listed.select("__row")), "__row", "left_anti")
    again = numbered.join(broadcast_if_small(listed.where("stays").select("__row")), "__row", "left_semi").dropDuplicates(["__row"])
    return alone.unionByName(again).select("doc.*")


def op8_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
