import math

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 0) for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, k=4):
    """{(row, component): (n, deviation, |whitened|, explained)} by an eigenvalue routine, over distinct vectors."""
    kept = usable(rows)
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array(fit, float) - np.array(sums) / n
    e, u = np.linalg.eigh(m.T @ m / n)
    out = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(k, len(e))):
            if e[-1 - c] > 1e-9 * e[-1]:
                out.append((i, c + 1, n, deviation, abs((np.array(x, float) - np.array(sums) / n) @ u[:, -1 - c]) / math.sqrt(e[-1 - c]), e[-1 - c] / e.sum()))
    return out


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) + rng.normal(size=d)
    return [(i, list(map(float, v))) for i, v in enumerate(m.astype(np.float32))]


def compare(got, want):
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[3])
    got = sorted(map(tuple, got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[4]) == pytest.approx(w[4], rel=1e-8, abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 1e-9


@pytest.mark.parametrize("d", [2, 3, 7, 24])
def test_equals_an_eigenvalue_routine(spark, d):
    rows = vectors(300, d, d)
    rows += [(1000 + i, rows[5][1]) for i in range(90)]  # copies count once in the fit
    rows += [(None, rows[7][1]), (3, rows[3][1]), (3, rows[3][1]), (2000, None), (2001, []), (2002, [None] * d), (2003, [math.nan] * d), (2004, [1.0] * (d - 1) + [math.inf])]
    got = whitening.whiten(frame(spark, rows)).collect()
    compare(got, brute(rows))
    signs = {}
    for r in got:  # copies have the same sign
        if r.vec_id in (5, *range(1000, 1090)):
            signs.setdefault(r.component, set()).add(round(r.whitened, 9))
    assert all(len(s) == 1 for s in signs.values())


def test_sizes_apart_few_rows_and_low_rank(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(1, 20)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got)
    both = vectors(40, 3, 1) + [(100 + i, v) for i, v in vectors(30, 5, 2)]
    got = whitening.whiten(frame(spark, both)).collect()
    compare([r for r in got if r.vec_id < 100], brute(both[:40]))
    compare([r for r in got if r.vec_id >= 100], brute(both[40:]))
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_large_values_stay_exact(spark):
    rows = [(i, [1e6 * i + 0.25, -3e6 * (i % 5), float(i)]) for i in range(30)]
    got = whitening.whiten(frame(spark, rows), most=1).collect()
    want = [r for r in brute(rows) if r[1] == 1]
    compare(got, [(*r[:3], min(r[3], 2**63 - 1), *r[4:]) for r in want])
    huge = [(i, [1e30 * (i - 3), float(i)]) for i in range(7)]
    assert {r.deviation for r in whitening.whiten(frame(spark, huge)).collect() if r.vec_id != 3} == {2**63 - 1}


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for d, k in ((1, 1), (5, 5), (9, 4), (40, 40)):
        m = rng.normal(size=(d, k))
        a = m @ m.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == min(d, k) and np.allclose(factor @ factor.T, a, atol=1e-10 * np.abs(a).max())
        w = whitening.jacobi(factor)
        g = w.T @ w
        assert np.abs(g - np.diag(np.diag(g))).max() < 1e-12 * np.abs(g).max()
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
