"""Whitening against plain whole-number arithmetic and a library's eigenvectors."""

import numpy as np
import pytest

from tidemill.llm import whitening


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    low = rng.normal(size=(9, 4))
    for matrix in (low @ low.T, np.diag([4.0, 0, 9, 1]), np.zeros((3, 3)), np.full((2, 2), 5.0), low.T @ low * 1e-9):
        factor, order = whitening.pivoted_cholesky(matrix)
        assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12 * max(1, np.abs(matrix).max()))
        assert np.array_equal(factor[: factor.shape[1]], np.tril(factor[: factor.shape[1]]))
        vectors, values = whitening.components_of(matrix)
        expected = np.sort(np.linalg.eigvalsh(matrix))[::-1][: len(values)]
        assert np.allclose(values, expected, rtol=1e-10)
        assert len(values) == np.linalg.matrix_rank(matrix)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
        assert np.allclose(matrix @ vectors.T, vectors.T * values, atol=1e-10 * max(1, np.abs(matrix).max()))


@pytest.mark.parametrize("columns", [0, 1, 2, 5, 8])
def test_rounds_have_every_pair_once(columns):
    pairs = [tuple(sorted(pair)) for a, b in whitening.rounds(columns) for pair in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(pairs) == [(a, b) for a in range(columns) for b in range(a + 1, columns)]


def test_products_beyond_doubles_and_longs():
    huge = np.array([[1 << 40, -3], [5, 1 << 50]], np.int64)
    assert whitening.exact_products(huge)[1, 1] == 9 + (1 << 100)
    small = np.array([[2, 3], [-4, 5]], np.int64)
    assert whitening.exact_products(small).tolist() == [[20, -14], [-14, 34]]


def test_rows_against_plain_arithmetic(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(5, 5))
    vectors = [(rng.normal(size=5) @ mix).astype(np.float32).tolist() for _ in range(400)]
    vectors += [vectors[0]] * 200  # a third of the rows is one vector
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [1.0, 2.0]]
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors)] + [(None, vectors[3], 2, "y"), (7, vectors[7], 3, "z")]
    rows += [(1000 + i, v, 4, None) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string").repartition(9)
    found = whitening.whiten(table, most=3).toPandas()
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v, _, _ in rows if v in vectors], object)
    n, sums = len(x), x.sum(0)
    assert len(found) == 3 * n and set(found.n) == {n} and found.vec_id.isna().sum() == 3
    centred = (n * x - sums).astype(float) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    for row in found[found.vec_id.notna()].drop_duplicates(["vec_id", "component"]).itertuples():
        at = int(row.vec_id)
        assert int(row.deviation) == ((n * x[at] - sums) ** 2).sum()
        assert abs(row.whitened) == pytest.approx(abs(centred[at] @ columns[:, -row.component]) / values[-row.component] ** 0.5, abs=1e-9)
        assert row.explained == pytest.approx(values[-row.component] / values.sum(), rel=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_without_variance_there_are_no_components(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.collect() == []
