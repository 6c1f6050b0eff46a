"""Projection and reconstruction against numpy's eigenvectors."""

import numpy as np

from fieldscope.operators import matrix as M

COLS = ["a", "b", "c", "d"]


def _data():
    rng = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    return rng.normal(size=(120, 4)) * [4.0, 2.0, 1.0, 0.25] @ turn + [1.0, -2.0, 0.5, 9.0]


def _axes(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    vectors = vectors[:, ::-1][:, :k]
    return values[::-1], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)


def test_axes_scores_and_errors(spark):
    x = _data()
    train, k = x[:80], 2
    df = lambda rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, a double, b double, c double, d double")
    p = M.fit_projection(df(train), COLS, k)
    values, vectors = _axes(train, k)
    assert np.allclose(p.loadings, vectors, atol=1e-9) and np.allclose(p.explained, values[:k] / values.sum(), atol=1e-9)
    centred = x - train.mean(axis=0)
    scores = np.array([[r.z1, r.z2] for r in p.project(df(x), ["id"]).orderBy("id").collect()])
    assert np.allclose(scores, centred @ vectors, atol=1e-9)
    errors = np.array([r.error for r in p.reconstruction_error(df(x), ["id"]).orderBy("id").collect()])
    assert np.allclose(errors, ((centred - centred @ vectors @ vectors.T) ** 2).mean(axis=1), atol=1e-9)
    norms = np.array([[r.row_norm, r.image_norm] for r in p.norms(df(x), ["id"]).orderBy("id").collect()])
    assert np.allclose(norms[:, 0], (centred**2).sum(axis=1)) and np.allclose(norms[:, 0] - norms[:, 1], errors * 4)
    s = M.error_summary(p.reconstruction_error(df(x), ["id"])).first()
    assert np.allclose([s["min"], s["median_upper"], s["max"], s["mean"]], [errors.min(), np.sort(errors)[60], errors.max(), errors.mean()])


def test_same_axes_whatever_the_order_of_rows(spark):
    rows = [(i, *map(float, r)) for i, r in enumerate(_data())]
    fit = lambda r, n: M.fit_projection(spark.createDataFrame(r, "id long, a double, b double, c double, d double").repartition(n), COLS, 3).loadings
    assert np.allclose(fit(rows, 1), fit(rows[::-1], 5), atol=1e-9)
