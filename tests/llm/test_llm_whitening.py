from fractions import Fraction
from math import floor, inf, nan, prod

import numpy as np
import pyarrow.parquet as pq
import pytest

from keydrift.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def by_hand(vectors):
    """n, scatter, deviations with integers; the eigenvalues and vectors by numpy."""
    x = [[floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    off = np.array([[n * r[k] - sums[k] for k in range(d)] for r in x], object)
    scatter = off.T @ off  # n^2 times n times the covariance
    return n, off, np.array(scatter, float) / float(n) ** 3


def test_whole_table_against_numpy(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    n, off, cov = by_hand(table["embedding"])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = (off / n).astype(float) @ axes / np.sqrt(values)
    got = whitening.query(spark, SF).orderBy("vec_id", "component").collect()
    assert len(got) == 8 * n
    ids = sorted(table["vec_id"])
    at = {v: k for k, v in enumerate(table["vec_id"])}
    w = np.array([r["whitened"] for r in got]).reshape(n, 8)
    want = want[[at[i] for i in ids]]
    want *= np.sign((want * w).sum(axis=0))
    assert abs(w - want).max() < 1e-8
    assert [r["deviation"] for r in got[::8]] == [sum(int(v) ** 2 for v in off[at[i]]) for i in ids]
    assert np.allclose([r["explained"] for r in got[:8]], values / np.trace(cov), rtol=1e-10)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-10


def test_polynomial_and_roots_of_known_matrices(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-9, 10, (6, 4))
    matrix = [[int(v) for v in row] for row in a @ a.T]  # rank 4: two roots are 0
    poly = whitening.characteristic(spark, matrix)
    assert poly[:2] == [0, 0] and poly[-1] == 1 and poly[5] == -sum(matrix[k][k] for k in range(6))

    def det(m):
        m, out = [[Fraction(v) for v in r] for r in m], Fraction(1)
        for k in range(len(m)):
            top = next((i for i in range(k, len(m)) if m[i][k]), None)
            if top is None:
                return 0
            if top != k:
                m[k], m[top], out = m[top], m[k], -out
            out *= m[k][k]
            for i in range(k + 1, len(m)):
                f = m[i][k] / m[k][k]
                m[i] = [p - f * q for p, q in zip(m[i], m[k], strict=True)]
        return out

    for t in (1, -3, 17):
        assert sum(c * t**k for k, c in enumerate(poly)) == det([[t * (i == j) - v for j, v in enumerate(r)] for i, r in enumerate(matrix)])
    found = whitening.largest_roots(poly, 8)
    assert [m for _, m in found] == [1] * 4
    assert np.allclose([r / 2**whitening.SCALE for r, _ in found], np.linalg.eigvalsh(np.array(matrix, float))[::-1][:4])


def test_counts_of_equal_roots():
    # (t - 5)^3 (t - 2) t
    poly = [0, 250, -275, 105, -17, 1]
    assert [whitening.roots_above(poly, t) for t in (-1, 0, 1, 2, 4, 5, 6)] == [5, 4, 4, 3, 3, 0, 0]
    assert [(round(r / 2**whitening.SCALE, 12), m) for r, m in whitening.largest_roots(poly, 8)] == [(5, 3), (2, 1)]
    assert sum(m for _, m in whitening.largest_roots(poly, 2)) >= 2
    assert prod(whitening.primes_beyond(1 << 100)) > 1 << 100


@pytest.mark.parametrize("share", [0, 1])
def test_equal_eigenvalues_and_close_ones(spark, share):
    # axes of equal spread, then all but equal: whitened to the identity all the same
    rows = [(4 * k + 2 * i + s, [float((-1) ** s) * (4096 + share * (i == k) / 1024) if i == k else 0.0 for i in range(3)]) for k in range(3) for i in range(2) for s in range(2)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and got[0]["identity_error"] < 1e-9
    assert abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12


def test_defined_cases(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 1.0])]
    good = [(6, [0.5, 0.25]), (6, [0.5, 0.25]), (None, [0.125, -1.0]), (7, [0.75]), (8, []), (9, [-0.0001, 3.0])]
    got = whitening.whitened(spark.createDataFrame(bad + good, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {6, None, 7, 8, 9} and len(got) == 12 and got[0]["n"] == 6
    n, off, cov = by_hand([v + [0.0] * (2 - len(v)) for _, v in good])
    assert sorted(r["deviation"] for r in got)[::2] == sorted(sum(int(v) ** 2 for v in o) for o in off)
    assert np.allclose(sorted({r["explained"] for r in got}), sorted(np.linalg.eigvalsh(cov) / np.trace(cov)))
    for rows in ([], good[:1], good[:2], bad):
        assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries_and_clashing_columns(spark):
    rows = [(1, [3e38, 1.0], "w", 1), (2, [-3e38, 2.0], "w", 2), (3, [0.0, 1e9], "w", 3)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA + ", w string, component int")).collect()
    assert len(got) == 6 and got[0]["identity_error"] < 1e-6 and got[0]["deviation"] is None
