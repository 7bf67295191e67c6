"""Cross-fitted probabilities against Newton steps in numpy on the rows of the other folds."""

import random

import numpy as np

from triagelake.operators import policies


def newton(x, y, c):
    """Weights and shift of the least sum of log losses and |w|^2 / 2c, on scaled features."""
    w = np.zeros(x.shape[1] + 1)
    full, ridge = np.c_[x, np.ones(len(x))], np.diag([1 / c] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        w = w - np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (p - y) + ridge @ w)
    return w


def test_no_row_is_scored_by_a_model_that_saw_its_group(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        a, b = rng.gauss(0, 1), rng.gauss(3, 2)
        rows.append((i, f"g{rng.randrange(9)}", a, b, int(rng.random() < 1 / (1 + np.exp(-a + 0.3 * (b - 3))))))
    u = spark.createDataFrame(rows, "unit_id long, group_id string, a double, b double, y int")
    got = sorted(policies.cross_fit(u, ["a", "b"], "y", c=0.5, folds=3).select("unit_id", "group_id", "a", "b", "y", "fold", "p").collect())
    assert [r["unit_id"] for r in got] == list(range(120)) and len({(r["group_id"], r["fold"]) for r in got}) == len({r["group_id"] for r in got})
    x, y, fold = np.array([[r["a"], r["b"]] for r in got]), np.array([r["y"] for r in got]), np.array([r["fold"] for r in got])
    for k in range(3):
        seen = fold != k
        mean, scale = x[seen].mean(0), x[seen].std(0)
        w = newton((x[seen] - mean) / scale, y[seen], 0.5)
        expected = 1 / (1 + np.exp(-(((x[~seen] - mean) / scale) @ w[:-1] + w[-1])))
        assert np.allclose([r["p"] for r in got if r["fold"] == k], expected, atol=1e-4)
