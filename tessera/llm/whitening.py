"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Vectors are quantised to integers. The fit list holds each distinct vector once; its sums are exact integers. A second
pass adds up the scatter of centred vectors, a matrix of fixed size a task, merged in two steps. The scatter A = L L' is
factored with pivoting, which stops where what is left is rounding. Jacobi rotations turn the columns of L until they are
orthogonal: then A = W W', so squared lengths of W's columns over n are the eigenvalues of the covariance, and columns
over their lengths its eigenvectors. A third pass measures the covariance of what comes out.

Defined results: vectors that are null or empty, or that hold a null, NaN or infinity, are dropped, null ids are kept;
repeated rows each get their rows, and count once in the fit; vectors of each number of components have a fit of their own;
a component whose eigenvalue is nothing but rounding (so all of a fit of one vector) has no rows; a component's largest entry
is positive (of ties the first); a deviation beyond 64 bits counts as the largest long; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table

MERGERS = 32  # tasks that merge scatters before the last one
SWEEPS = 60


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, x, d)`` of the usable rows: x holds floor(scale * c) as integers, d how many."""
    x = F.col(vector)
    usable = (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    return rows.select(F.col(key).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")).withColumn("d", F.size("x"))


def _groups(batches, at: int = 0):
    """(d, rows as a matrix of integers, their batch) for each number of components in each batch of ``(x, d)`` from column ``at``."""
    for batch in batches:
        sizes = batch.column(at + 1).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            part = batch.filter(pa.array(sizes == d))
            yield int(d), part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1), part


def _magnitude(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min())))


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n times the distance from the mean, in exact integers: of 64 bits where they hold it, else Python's."""
    if n * _magnitude(x) + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(t: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact, at most the largest long."""
    if t.dtype != object and _magnitude(t) ** 2 * t.shape[1] < 1 << 63:
        return (t * t).sum(axis=1)
    return np.array([min(sum(int(a) * int(a) for a in row), 2**63 - 1) for row in t], np.int64)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', its columns in the order of the pivots; it stops at what is rounding of the largest diagonal entry."""
    rest, columns = a.copy(), []
    least = len(a) * np.finfo(float).eps * max(float(np.diag(a).max()), 0.0)
    for _ in range(len(a)):
        at = int(np.argmax(np.diag(rest)))
        if not rest[at, at] > least:
            break
        column = rest[:, at] / np.sqrt(rest[at, at])
        rest -= np.outer(column, column)
        rest[at, :] = rest[:, at] = 0.0
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((len(a), 0))


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with columns rotated until every two are orthogonal; each round turns disjoint pairs, a round robin is a sweep."""
    w, k = factor.copy(), factor.shape[1]
    if k < 2:
        return w
    seats = list(range(k)) + [-1] * (k % 2)
    half = len(seats) // 2
    for _ in range(SWEEPS):
        turned = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(a, b) for a, b in zip(seats[:half], seats[: half - 1 : -1], strict=True) if a >= 0 and b >= 0]
            i, j = (np.array(x) for x in zip(*pairs, strict=True))
            p, q = w[:, i], w[:, j]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            off = np.abs(pq) / np.maximum(np.sqrt(pp * qq), np.finfo(float).tiny)
            turned = max(turned, float(off.max()))
            act = off > 1e-15
            zeta = np.divide(qq - pp, 2 * pq, out=np.zeros_like(pq), where=act)
            t = np.where(act, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            w[:, i], w[:, j] = c * p - c * t * q, c * t * p + c * q
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if turned <= 1e-15:
            break
    return w


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvectors as columns, eigenvalues) of scatter / n, the largest first."""
    w = jacobi(pivoted_cholesky(scatter))
    lengths = np.sqrt((w * w).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")[:most]
    u = w[:, order] / lengths[order]
    if u.size:
        u *= np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])])
    return u, lengths[order] ** 2 / n


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(n, exact sums) of the fit list for each number of components."""
    def partial(batches):
        total: dict[int, list] = {}
        for d, m, _ in _groups(batches):
            wide = m if _magnitude(m) * len(m) < 1 << 62 else m.astype(object)
            got = total.setdefault(d, [0, [0] * d])
            got[0] += len(m)
            got[1] = [a + int(b) for a, b in zip(got[1], wide.sum(axis=0), strict=True)]
        for d, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
                names=["d", "at", "n", "s"],
            )

    # One row for each component of each number of components.
    found = fit.mapInArrow(partial, "d int, at int, n long, s decimal(38,0)").groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found, key=lambda r: (r.d, r.at)):
        out.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return out


def _added(batches, found):
    """One ``(d, m)`` for each number of components: the sum of the matrices that ``found`` takes from the batches."""
    total: dict[int, np.ndarray] = {}
    for d, m in found(batches):
        total[d] = total[d] + m if d in total else m
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=["d", "m"])


def _stored(batches):
    for batch in batches:
        for d, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield d, np.frombuffer(m)


def _matrices(fit: DataFrame, found) -> dict[int, np.ndarray]:
    """Sums of what ``found`` gives for the vectors of the fit list, a matrix for each number of components."""
    partial = fit.mapInArrow(lambda b: _added(b, found), "d int, m binary")
    merged = partial.repartition(MERGERS).mapInArrow(lambda b: _added(b, _stored), "d int, m binary")
    out: dict[int, np.ndarray] = {}
    for r in merged.collect():  # at most MERGERS matrices of fixed size for each number of components
        out[r.d] = out.get(r.d, 0.0) + np.frombuffer(bytes(r.m))
    return out


def fitted(fit: DataFrame, most: int = 4) -> dict[int, dict]:
    """For each number of components: n, sums, eigenvectors, eigenvalues, shares of the trace, and the largest error of the whitened covariance."""
    sums = _sums(fit)

    def scatters(batches):
        for d, m, _ in _groups(batches):
            centred = apart(m, *sums[d]).astype(float) / sums[d][0]
            yield d, centred.T @ centred

    out = {}
    for d, flat in _matrices(fit, scatters).items():
        n, own = sums[d]
        a = flat.reshape(d, d)
        u, e = components((a + a.T) / 2, n, most)
        out[d] = {"n": n, "sums": own, "u": u, "e": e, "share": e * n / max(float(np.trace(a)), np.finfo(float).tiny)}

    def covariances(batches):
        for d, m, _ in _groups(batches):
            z = projected(apart(m, *sums[d]), out[d])
            yield d, z.T @ z

    for d, flat in _matrices(fit, covariances).items():
        k = len(out[d]["e"])
        out[d]["error"] = float(np.abs(flat.reshape(k, k) / out[d]["n"] - np.eye(k)).max()) if k else 0.0
    return out


def projected(t: np.ndarray, model: dict) -> np.ndarray:
    """Whitened rows of ``apart``."""
    return (t.astype(float) / model["n"]) @ model["u"] / np.sqrt(model["e"])


def whiten(vectors: DataFrame, most: int = 4, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` for each usable row and component up to ``most``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, key, vector)
    fit = stage(rows.select("x", "d").distinct(), "whitening-fit")
    models = spark.sparkContext.broadcast(fitted(fit, most))  # most + 1 numbers a component for each number of components

    def run(batches):
        for d, m, part in _groups(batches, 1):
            model = models.value[d]
            k, t = len(model["e"]), apart(m, model["n"], model["sums"])
            if not k:
                continue
            r = len(m)
            again = np.repeat(np.arange(r), k)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, model["n"], np.int64)), pa.array(deviations(t)[again]),
                 pa.array(projected(t, model).reshape(-1)), pa.array(np.tile(model["share"], r)), pa.array(np.full(r * k, model["error"]))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema[key].dataType.simpleString()
    out = rows.select("id", "x", "d").mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", key)


def op12_whitening_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
