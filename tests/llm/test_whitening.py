import numpy as np
import pytest

from meridia.llm import whitening

ROW = "vec_id long, embedding array<float>, component int, n string"


def rows_of(vectors):
    return [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(vectors)]


@pytest.mark.parametrize("shape,offset", [((300, 12), 0.0), ((40, 3), 5000.0), ((6, 10), 1.0)])
def test_whitened_as_by_an_eigensolver(spark, shape, offset):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=shape) * np.arange(1, shape[1] + 1) + offset).astype(np.float32)
    x = np.floor(1024 * vectors.astype(float)) + 100_000
    n, total = len(x), x.sum(0)
    z = x - total / n
    values, units = np.linalg.eigh(z.T @ z / n)
    values, units = values[::-1], units[:, ::-1]
    most = min(8, shape[1], n - 1)
    out = whitening.whiten(spark.createDataFrame(rows_of(vectors), ROW).repartition(5)).toPandas()
    assert len(out) == n * most and set(out["n"]) == {n}
    table = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(np.abs(table), np.abs(z @ units[:, :most] / np.sqrt(values[:most])), atol=1e-7)
    assert np.allclose(out.groupby("component")["explained"].first(), values[:most] / values.sum(), rtol=1e-9)
    error = np.abs(table.T @ table / n - np.eye(most)).max()
    assert out["identity_error"].nunique() == 1 and abs(out["identity_error"][0] - error) < 1e-9 and error < 1e-4
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x]
    assert [int(d) for d in out.groupby("vec_id")["deviation"].first()] == far


def test_factors_keep_the_matrix_and_show_its_rank():
    rng = np.random.default_rng(1)
    half = rng.normal(size=(9, 4))
    factor = whitening.pivoted_cholesky(half @ half.T)
    assert factor.shape == (9, 4) and np.allclose(factor @ factor.T, half @ half.T)
    values, units = whitening.one_sided_jacobi(factor)
    assert np.allclose(units.T @ units, np.eye(4)) and np.all(np.diff(values) <= 0)
    assert np.allclose(units * values @ units.T, half @ half.T)
    equal, _ = whitening.one_sided_jacobi(whitening.pivoted_cholesky(np.eye(3)))
    assert np.allclose(equal, 1)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [3.0, 3.0]]
    rows = rows_of(good) + [(9, None, 1, "x"), (9, [], 1, "x"), (9, [1.0, None], 1, "x"), (9, [nan, 1.0], 1, "x"), (9, [1.0, -inf], 1, "x"), (9, [1.0, 2.0, 3.0], 1, "x"), (None, [0.0, 0.0], 1, "x"), (0, [1.0, 0.0], 1, "x")]
    out = whitening.whiten(spark.createDataFrame(rows, ROW)).toPandas()
    assert set(out["n"]) == {6} and len(out) == 12 and out["vec_id"].isna().sum() == 2 and (out["vec_id"] == 0).sum() == 4


def test_no_variance_no_rows(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        out = whitening.whiten(spark.createDataFrame(rows_of(vectors), ROW))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    constant = whitening.whiten(spark.createDataFrame(rows_of([[7.0, 1.0], [7.0, 2.0]]), ROW)).toPandas()
    assert len(constant) == 2 and np.allclose(constant["explained"], 1) and np.allclose(constant["whitened"].abs(), 1)


def test_exact_where_products_pass_63_bits():
    model = whitening.Whitening(3_000_000_000, [10**17, 5], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[1 << 40, 7], [3, -(1 << 40)]])
    assert model.deviation(x) == [sum((model.n * int(a) - s) ** 2 for a, s in zip(r, model.sums)) for r in x]
