"""Whitening against numpy, its exact parts against whole-number arithmetic, and rows out of the ordinary."""

from fractions import Fraction

import numpy as np
import pytest

from roadgeo.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")


def plain(vectors, components=32):
    """Deviation, whitened, explained by numpy, on x."""
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return ((len(x) * x - x.sum(0)) ** 2).sum(1), (x - x.mean(0)) @ u / np.sqrt(e), e / np.trace(v)


def wide(rows, ids):
    found = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    k = max(c for _, c in found)
    return np.array([[found[i, c] for c in range(1, k + 1)] for i in ids])


def test_given_vectors(spark):
    rows = queries.op12_whitening(spark, SF).collect()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    deviation, whitened, explained = plain([r["embedding"] for r in given])
    ids = [r["vec_id"] for r in given]
    assert len(rows) == 32 * len(ids) and {r["n"] for r in rows} == {len(ids)}
    got = wide(rows, ids)
    assert np.abs(np.abs(got) - np.abs(whitened)).max() < 1e-6
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: int(d) for i, d in zip(ids, deviation)}
    assert np.allclose([r["explained"] for r in rows if r["vec_id"] == ids[0]], explained)
    cov = np.cov(got.T, bias=True)
    assert {round(r["identity_error"], 12) for r in rows} == {round(np.abs(cov - np.eye(32)).max(), 12)}


def test_polynomial_of_a_matrix(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(-(10**9), 10**9, (7, 9)).astype(object)
    a = m @ m.T
    poly = whitening.polynomial(spark, a)

    def det(rows):
        rows, out = [[Fraction(x) for x in r] for r in rows], Fraction(1)
        for c in range(len(rows)):
            p = next((i for i in range(c, len(rows)) if rows[i][c]), None)
            if p is None:
                return 0
            if p != c:
                rows[c], rows[p], out = rows[p], rows[c], -out
            out *= rows[c][c]
            for i in range(c + 1, len(rows)):
                f = rows[i][c] / rows[c][c]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[c])]
        return out

    for t in (0, 1, -5, 10**15):
        assert det([[t * (i == j) - a[i, j] for j in range(7)] for i in range(7)]) == sum(c * t**k for k, c in enumerate(poly))


@pytest.mark.parametrize("roots", [[9, 7, 7, 7, 2, 0], [5, 5], [1 << 70, 3, 1], [4]])
def test_roots_and_their_groups(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    for k, r in enumerate(roots, 1):
        if r:
            low, high, first = whitening.root(poly, k, 40, sum(roots) + 1)
            assert low < r << 40 <= high and high - low == 1 and first == roots.index(r) + 1


def test_zero_pivots_and_blocks():
    a = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]], object)  # (t - 1) (t - 3)^3
    assert whitening.polynomial_mod(a, 101) == [c % 101 for c in (27, -54, 36, -10, 1)]


def test_close_and_equal_eigenvalues(spark):
    # Three axes of the same spread, and one that all but equals them.
    steps = [np.eye(5)[i] * s * (1 + (i == 3) / 64) for i in range(4) for s in (3, -3)]
    rows = whitening.whiten(frame(spark, [list(s) for s in steps])).collect()
    got = wide(rows, range(8))
    assert got.shape[1] == 4  # the fifth dimension does not vary
    assert np.abs(np.cov(got.T, bias=True) - np.eye(4)).max() < 1e-12
    assert max(r["identity_error"] for r in rows) < 1e-12


def test_rows_that_are_dropped_or_odd(spark):
    vectors = [[1, 2, 3], [2, 1, 0.5], None, [1, None, 2], [float("nan"), 1, 1], [1, float("inf"), 0], [4], [], [1, 2, 3]]
    df = frame(spark, vectors)
    null_id = spark.createDataFrame([(None, [0.25, 3.0, 1.0])], "vec_id bigint, embedding array<double>")
    clash = df.union(null_id).selectExpr("*", "1 as component", "2 as n", "3 as x", "4 as label")
    rows = whitening.whiten(clash).collect()
    kept = [[1, 2, 3], [2, 1, 0.5], [4, 0, 0], [0, 0, 0], [1, 2, 3], [0.25, 3, 1]]
    deviation, whitened, _ = plain(kept)
    ids = [0, 1, 6, 7, 8, None]
    assert {r["vec_id"] for r in rows} == set(ids) and len(rows) == 18
    assert np.abs(np.abs(wide(rows, ids)) - np.abs(whitened)).max() < 1e-9
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == {i: int(d) for i, d in zip(ids, deviation)}


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(frame(spark, [[1, 2]] * 3)).count() == 0
    assert whitening.whiten(frame(spark, [[1, 2]]).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [None])).count() == 0


def test_large_components_are_exact_or_refused(spark):
    big = float(1 << 44)
    rows = whitening.whiten(frame(spark, [[big, 1], [-big, 2], [big / 3, 5]])).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in ([big, 1], [-big, 2], [big / 3, 5])]
    s = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == {i: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    with pytest.raises(Exception, match="no exact place"):
        whitening.whiten(frame(spark, [[1e300, 1], [2, 3]])).collect()


def test_products_in_halves():
    y = np.array([[(1 << 50) + 3, -(1 << 49) - 7], [-5, (1 << 51) + 1]] * 300)
    assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()
