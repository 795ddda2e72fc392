"""Whitening against Python's integers and fractions, one number at a time."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from quizloom.llm import queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def _x(vector):
    return [floor(64 * c) + 1000000 for c in vector]


def _check(rows, got, most=32):
    """got: what whiten() returned for the vectors of rows, all of which take part."""
    xs = [_x(v) for _, v in rows]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    cov = [[sum(Fraction(x[i] * n - sums[i], n) * Fraction(x[j] * n - sums[j], n) for x in xs) / n for j in range(d)] for i in range(d)]
    values = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))[0][::-1]
    kept = [v for v in values if v > 1e-12 * values[0]][:most]
    assert len(got) == n * len(kept)
    trace = float(sum(cov[i][i] for i in range(d)))
    white = np.zeros((n, len(kept)))
    by_id = {vec_id: k for k, (vec_id, _) in enumerate(rows)}
    for r in got:
        k = by_id[r["vec_id"]]
        assert r["n"] == n
        assert r["deviation"] == sum((n * x - s) ** 2 for x, s in zip(xs[k], sums, strict=True))
        assert r["explained"] == pytest.approx(kept[r["component"] - 1] / trace, rel=1e-6)
        assert r["identity_error"] < 1e-6
        white[k, r["component"] - 1] = r["whitened"]
    assert np.abs(white.T @ white / n - np.eye(len(kept))).max() < 1e-6
    centred = np.array([[float(Fraction(x[i] * n - sums[i], n)) for i in range(d)] for x in xs])
    for c, value in enumerate(kept):  # each column is the projection on an eigenvector of this value
        vector = centred.T @ white[:, c] / n / np.sqrt(value)
        assert np.linalg.norm(vector) == pytest.approx(1, abs=1e-6)
        residue = np.array([[float(v) for v in row] for row in cov]) @ vector - value * vector
        assert np.abs(residue).max() < 1e-6 * values[0]


def test_small_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) * [1, 3, 0.2, 9, 1]).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    _check(rows, whitening.whiten(df).collect())


def test_values_beyond_every_float_product(spark):
    rows = [(i, [float(i % 7) * 2**40 + i, float(i * i % 11) * 2**33, 0.5 * i]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    model = whitening.fit(df)
    n, sums, exact = whitening.scatter(df, 3)
    ys = [[floor(64 * c) for c in v] for _, v in rows]
    assert sums == [sum(y[i] for y in ys) for i in range(3)] and n == 30
    assert exact == [[30 * sum(y[i] * y[j] for y in ys) - sums[i] * sums[j] for j in range(3)] for i in range(3)]
    got = whitening.whiten(df).collect()
    assert len(got) == 30 * len(model.eigenvalues)
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 0)  # over 2**63


def test_exact_scatter_of_random_longs():
    rng = np.random.default_rng(2)
    y = rng.integers(-(2**62), 2**62, (50, 4))
    sums, products = whitening.exact_scatter(y)
    o = y.astype(object)
    assert (sums == o.sum(0)).all() and (products == o.T @ o).all()
    total = {}
    for k, limb in whitening._limbs(products.ravel()):
        for i, v in enumerate(limb.tolist()):
            total[i] = total.get(i, 0) + (v << 32 * k)
    assert [total[i] for i in range(16)] == products.ravel().tolist()


def test_what_takes_no_part_and_odd_rows(spark):
    good = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [2.0, 0.0]), (4, [2.0, 0.5])]
    odd = [(5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, []), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, None, "x") for i, v in good + odd], "vec_id long, embedding array<double>, label int, n string")
    _check(good, whitening.whiten(df).collect())
    twice = spark.createDataFrame([(i, v, 0) for i, v in [*good, *good, (None, [0.0, 0.0])]], SCHEMA)
    got = whitening.whiten(twice).collect()
    assert len(got) == 18 and {r["n"] for r in got} == {9} and sum(r["vec_id"] is None for r in got) == 2


def test_no_rows_one_row_and_a_constant_column(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    rows = [(i, [float(i), 7.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    _check(rows, got)
    assert {r["component"] for r in got} == {1}


def test_whole_table(spark, tiny):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_whitening"](spark, tiny).collect()
    x = np.array([_x(v) for _, v in rows], float)
    z = x - x.mean(0)
    values, axes = np.linalg.eigh(z.T @ z / len(x))
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    want = z @ axes / np.sqrt(values)
    at = {vec_id: k for k, (vec_id, _) in enumerate(rows)}
    white = np.zeros((len(rows), 32))
    for r in got:
        white[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert len(got) == 32 * len(rows)
    signs = np.sign((white * want).sum(0))
    assert np.abs(white * signs - want).max() < 1e-6
    assert max(r["identity_error"] for r in got) < 1e-9


def test_finite_and_width(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,), ([None],)], "embedding array<double>")
    assert df.where(vectors.finite()).count() == 2
    assert vectors.commonest_width(df.where(vectors.finite())) == 2
