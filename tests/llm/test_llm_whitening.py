"""Spectrum slicing and whitening against numpy's eigensolver and exact integers."""

import numpy as np
import pytest

from tallybook.llm import spectrum, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def frame(spark, vectors, schema=SCHEMA):
    lists = [None if v is None else [None if x is None else float(x) for x in v] for v in vectors]
    rows = [(i, v, "own", None) for i, v in enumerate(lists)]
    return spark.createDataFrame(rows, schema)


def expected(x, count):
    """Fit list, covariance, leading values and vectors of integer rows."""
    listed = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(listed), listed.sum(axis=0)
    centre = (n * listed - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    return n, sums, values[::-1][:count], vectors[:, ::-1][:, :count], values.sum()


def test_inertia_and_solutions():
    made = np.random.default_rng(1)
    for size in (1, 2, 7, 20):
        a = made.standard_normal((size, size))
        a = a + a.T
        factors = spectrum.Factors(a)
        assert factors.positive() == (np.linalg.eigvalsh(a) > 0).sum()
        b = made.standard_normal(size)
        assert np.allclose(a @ factors.solve(b, 1e-300), b)
    zero_diagonal = spectrum.Factors(np.array([[0.0, 2.0], [2.0, 0.0]]))
    assert zero_diagonal.positive() == 1


@pytest.mark.parametrize("kind", ["flat", "decay", "twins", "poor"])
def test_leading_pairs(kind):
    made = np.random.default_rng(2)
    x = made.standard_normal((400, 24))
    if kind == "decay":
        x = x * 0.4 ** np.arange(24)
    a = x.T @ x / 400
    if kind == "twins":
        a = np.diag(np.repeat([5.0, 5.0, 2.0, 1.0], 6))
    if kind == "poor":
        a = x[:, :2].T @ x[:, :2]
        a = np.pad(a, (0, 22))
    pairs = spectrum.leading(a, 4)
    wanted = np.linalg.eigvalsh(a)[::-1][: 2 if kind == "poor" else 4]
    assert np.allclose([v for v, _ in pairs], wanted, rtol=1e-13, atol=0)
    vectors = np.array([v for _, v in pairs])
    assert np.allclose(vectors @ vectors.T, np.eye(len(pairs)), atol=1e-12)
    assert all(np.linalg.norm(a @ v - value * v) <= 1e-13 * wanted[0] for value, v in pairs)
    assert spectrum.leading(np.zeros((3, 3)), 4) == []


def test_whitening_equals_eigenvectors(spark):
    made = np.random.default_rng(3)
    vectors = [v for v in (made.standard_normal((300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + 7).astype(np.float32)]
    vectors[10] = vectors[11] = vectors[12]
    vectors[20] = vectors[12] + np.float32(1e-6)  # another vector, the same x
    vectors[30] = [-0.0] * 6
    vectors += [None, [], [None] * 6, [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5]
    rows = whitening.whiten(frame(spark, vectors).repartition(5)).collect()
    used = np.array([v for v in vectors[:300]], float)
    x = np.floor(256 * used).astype(int)
    n, sums, values, basis, trace = expected(x, 4)
    assert n < 299
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c) for i in range(300) for c in (1, 2, 3, 4)]
    centre = (n * x - sums).astype(float) / n
    plain = centre @ basis / np.sqrt(values)
    got = np.zeros((300, 4))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, sum(int(d) ** 2 for d in n * x[r.vec_id] - sums))
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-12)
        assert r.identity_error < 1e-10
    signs = np.sign((got * plain).sum(axis=0))
    assert np.allclose(got, plain * signs, atol=1e-9)


def test_each_length_has_its_own_fit(spark):
    vectors = [[i, i * i % 7] for i in range(20)] + [[i % 3, 1, -i] for i in range(20)] + [[5.0]]
    rows = whitening.whiten(frame(spark, vectors), count=4).collect()
    counts = {i: sum(r.vec_id == i for r in rows) for i in range(41)}
    # one vector of length 1 has no variance; a constant dimension adds no component
    assert [counts[0], counts[25], counts[40]] == [2, 2, 0]
    assert all(r.identity_error < 1e-10 for r in rows)


def test_no_rows_and_equal_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [None, [None, 1.0]])).collect() == []
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).collect() == []


def test_huge_entries_stay_exact(spark):
    schema = SCHEMA.replace("float", "double")
    vectors = [[1e300, 0.0], [-1e300, 1.0], [2.0**54, 2.0], [0.0, 3.0]]
    rows = whitening.whiten(frame(spark, vectors, schema), count=1).collect()
    assert sorted(r.vec_id for r in rows) == [0, 1, 2, 3]
    assert all(r.deviation is None for r in rows)
    assert whitening.deviations(np.array([[2**32, 3], [-(2**31), 5]]), 2, [2**32 - 2**31, 8]) == [None, None]
    assert whitening.deviations(np.array([[2**29, 0], [2**40, 0]]), 3, [0, 5]) == [9 * 2**58 + 25, None]
    packed = whitening.packed(np.array([[1, -128], [300, 0], [2**40, 1], [-(2**63), 2**63 - 1]]))
    back = [m.tolist() for row in packed for m in whitening.unpacked(whitening.pa.array([row], whitening.pa.binary()))]
    assert back == [[[1, -128]], [[300, 0]], [[2**40, 1]], [[-(2**63), 2**63 - 1]]]
