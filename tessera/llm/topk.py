"""Exact top-k inner products, by norm-sorted blocks and SVD-rotated partial sums.

Vectors are quantised to integers and dealt, by their number of components and in descending order of length,
to blocks. For each number of components a rotation is fitted: the eigenvectors of the second-moment matrix, which
is summed over all vectors (a matrix of fixed size; the ``ROTATED`` most common numbers have one, others stay as they
are). Each block of queries meets blocks of candidates: first the block's largest length times the query
block's is set against the least k-th score so far, and by the Cauchy-Schwarz inequality a block below it is
never dealt out; then the product over the leading rotated coordinates plus the product of the residual lengths
bounds each pair, and only pairs that can reach the k-th score are multiplied in full, in integers. The
k-th score so far is that of the query among the longest vectors. Bounds carry a margin for rounding and only drop
what is strictly below, so ties stay and the result is exact.

Queries are a stated set; each is held against all rows in blocks, whose number of vectors is
fixed. What a block pair gives on is at most k rows a query.

Defined results: vectors that are null or empty, or that hold a null, NaN or infinity, take no part, nor
does a null id; a query meets the vectors of its own number of components, with others it has no product;
a query has fewer than k rows if there are fewer candidates; rows that repeat an id count as
candidates on their own, but make one query, by the least vector, which never meets its own id; ties go to the
smaller id; a product beyond 64 bits counts as the largest or smallest long; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, stage, table, unstage

CANDIDATES, QUERIES_A_BLOCK, LEAD = 4096, 512, 24
ROTATED, STEPS = 16, 4  # numbers of components with a rotation; levels of length in each doubling
BLOCKS_A_SLOT = 4096  # candidate blocks of one level that are met under one key


def quantised(vectors: DataFrame, is_query: Column, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v, asked, d, norm)`` of the usable rows: v holds floor(scale * x) as integers, d how many."""
    x = F.col(vector)
    usable = F.col(key).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(key).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    return rows.withColumn("d", F.size("v")).withColumn("norm", _norm())


def _norm() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the most common numbers of components an orthogonal matrix, its columns in descending order of the energy they hold."""
    common = [r.d for r in rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(ROTATED).collect()]

    def summed(pairs):
        total = {}
        for d, m in pairs:
            total[d] = total[d] + m if d in total else m
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["d", "m"])

    def moments(batches):
        def each():
            for batch in batches:
                sizes = batch.column(0).to_numpy(zero_copy_only=False)
                for d in np.unique(sizes):
                    m = _matrix(batch.column(1).filter(pa.array(sizes == d))).astype(np.float64)
                    yield int(d), m.T @ m

        yield from summed(each())

    def merged(batches):
        yield from summed((d, np.frombuffer(m)) for batch in batches for d, m in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    partial = rows.where(F.col("d").isin(common)).select("d", "v").mapInArrow(moments, "d int, m binary")
    found = partial.repartition(8).mapInArrow(merged, "d int, m binary").collect()  # at most eight matrices for each of a fixed number
    out = {}
    for r in found:
        out[r.d] = out.get(r.d, 0.0) + np.frombuffer(bytes(r.m))
    return {d: np.ascontiguousarray(np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]) for d, m in out.items()}


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def narrowed(m: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest of 2, 4 and 8 bytes that holds them all."""
    least, most = int(m.min()), int(m.max())
    kind = next((k for k in (np.int16, np.int32) if np.iinfo(k).min <= least and most <= np.iinfo(k).max), np.int64)
    return np.ascontiguousarray(m, kind)


def _unpacked(ids: bytes, vectors: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a block; how wide its integers are follows from their bytes."""
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(vectors, f"i{len(vectors) // (len(names) * d)}").reshape(-1, d).astype(np.int64)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows packed into blocks of about ``size``, of descending length: ``(name, longest, d, ids, vectors)``, with integers as narrow as each block allows."""
    n = rows.count()
    spread = max(1, -(-n // size))
    dealt = rows.repartitionByRange(spread, "d", F.desc("norm"), "id").sortWithinPartitions("d", F.desc("norm"), "id")

    def pack(batches):
        ids, vectors = [], []

        def packed():
            m, i = np.concatenate(vectors), np.concatenate(ids)
            for at in range(0, len(i), size):
                own = np.ascontiguousarray(m[at : at + size])
                longest = float(np.sqrt((own[0].astype(np.float64) ** 2).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([longest]), pa.array([own.shape[1]], pa.int32()), pa.array([i[at : at + size].tobytes()], pa.binary()), pa.array([narrowed(own).tobytes()], pa.binary())],
                    names=["longest", "d", "ids", "vectors"],
                )

        held = 0
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [len(sizes)]]) if len(sizes) else []
            for at, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at, end - at)
                m = _matrix(part.column(2)).astype(np.int64)
                if held >= 4 * size or vectors and vectors[0].shape[1] != m.shape[1]:
                    yield from packed()
                    ids.clear()
                    vectors.clear()
                    held = 0
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                vectors.append(m)
                held += len(m)
        if held:
            yield from packed()

    out = dealt.select("id", "d", "v").mapInArrow(pack, "longest double, d int, ids binary, vectors binary")
    return out.withColumn(name, F.monotonically_increasing_id())


def _products(c: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return c @ q
    found = (c.astype(object) * q.astype(object)).sum(axis=1)
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in found], np.int64)


def best_in_block(q_ids, q, c_ids, c, turn, k: int, floor=None):
    """(query index, candidate id, score) of at most k for each query, and those that tie below k are cut by id."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    lead = min(LEAD, q.shape[1])
    qr, cr = (qf, cf) if turn is None else (qf @ turn, cf @ turn)
    bound = qr[:, :lead] @ cr[:, :lead].T
    rest = lambda m: np.sqrt(np.maximum(0.0, (m[:, lead:] ** 2).sum(axis=1)))
    bound += rest(qr)[:, None] * rest(cr)[None, :]
    size = np.sqrt((qf**2).sum(axis=1))[:, None] * float(np.sqrt((cf**2).sum(axis=1).max()))
    bound += 1e-9 * size + 1e-6
    exact = bool(size.max() < 2.0**62)
    bound = np.clip(bound, -(2.0**63), 2.0**63)
    out = []
    for at in range(len(q)):
        others = np.flatnonzero(c_ids != q_ids[at])
        if not len(others):
            continue
        upper = bound[at, others]
        limit = -np.inf if floor is None else float(floor[at])
        if len(others) > k:
            first = others[np.argpartition(-upper, k - 1)[:k]]
            limit = max(limit, float(np.sort(_products(c[first], q[at], exact))[-k]))
        alive = others[upper >= limit]
        score = _products(c[alive], q[at], exact)
        keep = score >= limit
        alive, score = alive[keep], score[keep]
        order = np.lexsort((c_ids[alive], ~score))[:k]
        out.append((np.full(len(order), at), c_ids[alive[order]], score[order]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(pairs: DataFrame, turns: dict, k: int) -> DataFrame:
    """Best k of each block pair; rows hold a query block, a candidate block and perhaps floors."""
    shared = pairs.sparkSession.sparkContext.broadcast(turns)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                (q_ids, q), (c_ids, c) = (_unpacked(row[f"{x}_ids"], row[f"{x}_vectors"], d) for x in "qc")
                floor = None
                if row["floors"]:
                    at = dict(zip((f["id"] for f in row["floors"]), (f["floor"] for f in row["floors"]), strict=True))
                    floor = np.array([at.get(int(i), -(2**62)) for i in q_ids], np.float64)
                at, ids, score = best_in_block(q_ids, q, c_ids, c, shared.value.get(d), k, floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at.astype(np.int64)], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array(np.full(len(ids), row["qb"]), pa.int64())],
                    names=["query_id", "vec_id", "score", "qb"],
                )

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long, qb long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
          candidates: int = CANDIDATES, queries: int = QUERIES_A_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query."""
    rows = stage(quantised(vectors, is_query, scale, key, vector), "topk-rows")
    turns = rotations(rows)
    asked = rows.where("asked").groupBy("id", "d").agg(F.min("v").alias("v")).withColumn("norm", _norm())
    # One vector a query: the least, of whatever length.
    asked = asked.groupBy("id").agg(F.min_by(F.struct("d", "v", "norm"), "v").alias("q")).select("id", "q.*")
    named = lambda t: {x: f"{t}_{x}" for x in ("ids", "vectors", "longest")}
    c = stage(_blocks(rows, candidates, "cb").withColumnsRenamed(named("c")), "topk-c")
    q = stage(_blocks(asked, queries, "qb").withColumnsRenamed(named("q")), "topk-q")
    heads = stage(c.groupBy("d").agg(F.max_by("cb", F.struct("c_longest", -F.col("cb"))).alias("cb")), "topk-head")  # one row a number of components
    head_blocks = stage(c.join(broadcast_if_small(heads), ["d", "cb"], "left_semi"), "topk-heads")
    # A block counts by its numbers, so that no more than a few blocks are ever broadcast.
    seed = q.join(broadcast_if_small(head_blocks, (F.length("c_vectors") / 8).cast("long"), 1 << 21), "d").withColumn("floors", F.lit(None).cast("array<struct<id:long,floor:long>>"))
    first = stage(_search(seed, turns, k), "topk-first")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.groupBy("qb", "query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    # At most the queries of a block.
    floors = floors.groupBy("qb").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "floor")).alias("floors"), F.min("floor").alias("lowest"), F.count(F.lit(1)).alias("known"))
    floors = stage(floors, "topk-floors")
    # Blocks meet by level of length, of which there are a few hundred, from the least that could still matter on. Where
    # vectors are of one length, that level's blocks are dealt to slots, each of which meets the query blocks.
    level = lambda x: F.floor(F.log2(F.greatest(x, F.lit(1.0))) * STEPS).cast("int")
    sizes = q.select("qb", "d", "q_longest", (F.length("q_ids") / 8).cast("long").alias("held")).join(floors.select("qb", "lowest", "known"), "qb", "left")
    every = F.col("known").isNull() | (F.col("known") < F.col("held")) | (F.col("lowest") <= 0) | (F.col("q_longest") <= 0)
    sizes = sizes.withColumn("every", every).withColumn("from", F.when(every, 0).otherwise(F.greatest(F.lit(0), level(F.col("lowest") / F.col("q_longest")) - 1)))
    ends = c.agg(F.max(level(F.col("c_longest")))).first()[0] or 0
    met = F.col("every") | (F.col("q_longest") * F.col("c_longest") * (1 + 1e-9) + 1e-6 >= F.col("lowest"))
    others = c.join(broadcast_if_small(heads), ["d", "cb"], "left_anti").select("cb", "d", "c_longest", level(F.col("c_longest")).alias("level"))
    slots = max(1, -(-c.count() // BLOCKS_A_SLOT))
    others = others.withColumn("slot", F.pmod(F.xxhash64("cb"), F.lit(slots)).cast("int"))
    asking = sizes.where(F.col("from") <= ends).select("*", F.explode(F.sequence("from", F.lit(ends))).alias("level")).select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    pairs = stage(asking.join(others, ["d", "level", "slot"]).where(met).select("qb", "cb"), "topk-pairs")
    asked_blocks = q.select("qb", "q_ids", "q_vectors").join(floors.select("qb", "floors"), "qb", "left")
    rest = _search(pairs.join(asked_blocks, "qb").join(c, "cb"), turns, k)
    out = first.union(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    unstage(rows)
    return out.select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id != q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
