from __future__ import annotations

import math

import numpy as np
import pytest

from attestra.llm import whitening


def brute(rows, components=4, by_copies=False):
    """``{(id, repeat)}`` -> per component, from all rows of one length."""
    kept = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v) and len(v)]
    listed = [x for _, x in kept] if by_copies else [list(x) for x in {tuple(x) for _, x in kept}]
    n, x = len(listed), np.array(listed, np.float64)
    sums = [sum(column) for column in zip(*listed)]
    centred = x - x.mean(axis=0)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    z = centred @ axes / np.sqrt(values)
    error = np.abs((z - z.mean(axis=0)).T @ (z - z.mean(axis=0)) / n - np.eye(components)).max()
    out = []
    for k, v in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for i in range(components):
            out.append((k, i + 1, n, deviation, float((np.array(v) - np.array(sums) / n) @ axes[:, i] / math.sqrt(values[i])),
                        float(values[i] / np.trace(covariance)), float(error)))
    return out


def table(n=300, dim=8):
    rng = np.random.default_rng(4)
    base = [[float(c) for c in rng.normal(size=dim).astype(np.float32) * np.arange(1, dim + 1)] for _ in range(n)]
    copies = [base[0]] * 150 + [base[1]] * 3
    broken = [None, [None, *base[0][1:]], [math.nan, *base[0][1:]], [math.inf, *base[0][1:]]]
    vectors = base + copies + broken
    return [(i if i % 50 else None, v) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("by_copies", [False, True])
def test_equals_brute_force(spark, by_copies):
    rows = table()
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<float>, X int, salt int")
    got = sorted(whitening.whitened_rows(df, by_copies=by_copies).collect(), key=lambda r: (str(r.vec_id), r.component, r.deviation))
    want = sorted(brute(rows, by_copies=by_copies), key=lambda r: (str(r[0]), r[1], r[3]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    sign = {}
    for r, w in zip(got, want, strict=True):
        if abs(w[4]) > 0.1:
            assert sign.setdefault(r.component, math.copysign(1, r.whitened * w[4])) == math.copysign(1, r.whitened * w[4])
    for r, w in zip(got, want, strict=True):
        assert r.whitened == pytest.approx(sign[r.component] * w[4], abs=1e-9)
        assert r.explained == pytest.approx(w[5], rel=1e-12)
        assert r.identity_error < 1e-9


def test_lengths_are_fitted_apart_and_wide_values_stay_exact(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 0.5]), (3, [2.0, 7.5]), (4, [1e15, 1.0, 3.0]), (5, [-1e15, 2.0, 8.0]), (6, [5e14, 2.0, 1.0]), (7, []), (8, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened_rows(df).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4, 5, 6}
    x = [[256 * int(c) for c in v] for _, v in rows[3:6]]
    s = [sum(c) for c in zip(*x)]
    want = {i + 4: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got if r.vec_id >= 4} == want
    assert {r.n for r in got} == {3} and max(r.component for r in got if r.vec_id < 4) == 2


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whitened_rows(df).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.n == 1 and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = whitening.whitened_rows(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and {r.identity_error < 1e-9 for r in got} == {True}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened_rows(df).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, []), (3, [math.nan])], "vec_id long, embedding array<float>")
    assert whitening.whitened_rows(nothing).collect() == []
