"""Models against known answers."""

import numpy as np

from sievewright.operators import learning as L


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(float)
    w = L.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert np.abs(x.T @ (y - p) - w[:2]).max() < 1e-6 and abs((y - p).sum()) < 1e-6


def test_loocv_and_permutation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v), float(n)], int(v > 0)) for i, (v, n) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "rid long, x array<double>, y int")
    got = {r.rid: r.pred for r in L.loocv(df, "rid", "x", "y").collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    assert got == {i: L.predict_one(x, y, i) for i in range(60)} and sum(got[r[0]] == r[2] for r in rows) > 52
    r = L.permutation_test(df, "rid", "x", "y", 19, 5, 2).first()
    assert r.score > 0.85 and r.p == 0.05
    assert L.predict_one(x[:3], np.ones(3), 0) == 1 and L.loocv(df.where("rid < 0"), "rid", "x", "y").count() == 0
