import math

import numpy as np
import pytest

from corpusweft.llm import whitening as wh


def brute(rows):
    """The contract by numpy on centred vectors: (n, sums, covariance, {id: [deviation, whitened by component]})."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: np.array([math.floor(64 * c) + 1_000_000 for c in v], object) for i, v in kept}
    fit = [np.array(v, object) for v in {tuple(v) for v in x.values()}]
    n, sums = len(fit), sum(fit)
    centred = np.array([[float(c) for c in (n * v - sums)] for v in fit]) / n
    return n, sums, centred.T @ centred / n, x


def vectors(count=400, size=12, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, size)) @ rng.normal(size=(size, size)) + 3
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


def found(spark, rows, kind="array<double>", **options):
    return wh.whitened(spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(5), **options).collect()


def test_rows_match_brute_force(spark):
    rows = vectors()
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(2000, None), (2001, [None] * 12), (2002, [math.nan] * 12), (2003, [math.inf] + [0.0] * 11), (2004, []), (None, rows[3][1])]
    n, sums, covariance, x = brute(rows)
    out = found(spark, rows)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    assert len(out) == len(x) * 12 and {r.n for r in out} == {n}
    for r in out:
        y = n * x[r.vec_id] - sums
        assert r.deviation == sum(int(c) ** 2 for c in y)
        want = float(np.array([float(c) for c in y]) / n @ columns[:, r.component - 1] / math.sqrt(values[r.component - 1]))
        assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-6)
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
        assert r.identity_error < 1e-9


def test_whitened_rows_have_the_identity_as_covariance(spark):
    rows = vectors(700, 20, 2)
    out = np.zeros((700, 16))
    for r in found(spark, rows):
        out[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(out.T @ out / 700 - np.eye(16)).max() < 1e-9


def test_scatter_is_exact(spark):
    rows = [(i, [c * 1e9 for c in v]) for i, v in vectors(150, 5, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model, _ = wh.fit(df)
    _, sums, _, x = brute(rows)
    y = [model.n * v - sums for v in x.values()]
    assert model.scatter == [[sum(int(v[i]) * int(v[j]) for v in y) for j in range(5)] for i in range(5)]
    assert model.scatter[0][0] > 1 << 64 and len(wh.primes(model.n * model.reach**2)) > 4


def test_degenerate_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [])]) == []
    assert found(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == []  # one distinct vector: no variance
    flat = found(spark, [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)])  # rank one
    assert {r.component for r in flat} == {1} and len(flat) == 9 and flat[0].explained == pytest.approx(1)


def test_other_lengths_huge_entries_and_clashing_columns(spark):
    rows = vectors(30, 4, 4) + [(100, [1.0, 2.0]), (101, [1e300] * 4)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n int, whitened double")
    out = wh.whitened(df).collect()
    assert {r.vec_id for r in out} == set(range(30)) and len(out) == 120
    as_text = spark.createDataFrame([(f"v{i}", v) for i, v in rows[:30]], "vec_id string, embedding array<float>")
    assert wh.whitened(as_text, most=2).count() == 60


def test_deviation_beyond_a_long_is_null(spark):
    out = found(spark, [(k, [1e14 * k, float(k % 3)]) for k in range(5)])
    assert all(r.deviation is None for r in out if r.vec_id != 2)
