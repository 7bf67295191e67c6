"""Many models at once against fits one by one, and the redraws that they are fitted on."""

import numpy as np
from pyspark.sql import functions as F

from triagelake.operators import many


def newton(x, y, l2):
    w = np.zeros(x.shape[1] + 1)
    a = np.column_stack([x, np.ones(len(y))])
    ridge = np.array([l2] * x.shape[1] + [0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + np.diag(ridge), a.T @ (y - q) - ridge * w)
    return w


def test_equal_to_fits_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-(0.3 * k - 1 + a - 0.5 * b))))) for k in range(12) for a, b in rng.normal(size=(80 + k, 2)).round(1)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y int")
    jobs = []
    frame = type(df)
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: jobs.append(1) or f(self))
    found = many.fit(df, ["k"], ["a", "b"], "y", l2=0.5)
    steps = len(jobs) - 1  # the first counts the models
    got = {r["k"]: (r["a"], r["b"], r["intercept"]) for r in found.collect()}
    for k in range(12):
        own = np.array([r[1:] for r in rows if r[0] == k])
        assert np.allclose(got[k], newton(own[:, :2], own[:, 2], 0.5), atol=1e-7)
    assert steps < 15 and found.agg(F.sum("n")).first()[0] == len(rows)


def test_platt_falls_back(spark):
    rows = [("up", p / 10, int(p > 5) ^ (p in (3, 7))) for p in range(1, 10)] + [("down", p / 10, int(p < 5)) for p in range(1, 10)] + [("one", p / 10, 1) for p in range(1, 10)]
    found = {r["g"]: r for r in many.platt(spark.createDataFrame(rows, "g string, p double, y int"), ["g"], "p", "y").collect()}
    assert not found["up"]["fell_back"] and found["up"]["slope"] > 0
    assert found["down"]["fell_back"] and found["down"]["slope"] == 1 and found["one"]["shift"] == many.BOUND
    z = np.log(np.arange(1, 10) / (10 - np.arange(1, 10)))
    mean = (1 / (1 + np.exp(-(z + found["down"]["only_shift"])))).mean()
    assert abs(mean - 4 / 9) < 1e-9  # the shift makes the mean right


def test_redraws(spark):
    groups = spark.range(12).select(F.col("id").alias("g")).union(spark.range(12).select("id"))
    found = many.redraws(groups, "g", [2, 5, 12], 30, 1).collect()
    inside = {}
    for r in found:
        inside.setdefault((r["k"], r["draw"]), set()).update([r["g"]] if r["inside"] else [])
    assert len(found) == 2 * 30 * 12 and all(len(v) == k for (k, _), v in inside.items()) and len({frozenset(v) for (k, _), v in inside.items() if k == 5}) > 20


def test_learning_curve_against_numpy(spark):
    from triagelake.plans.queries_more import learning_curve

    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(1, 100)) / 100, i // 30) for i in range(450)]
    rows = [(i, r, int(rng.random() < r**2), g) for i, r, g in rows]
    df = spark.createDataFrame(rows, "unit_id long, r double, y int, shelf long")
    found = learning_curve(df, "shelf", (3, 20), 4).collect()
    assert len(found) == 4 * 3  # 15 shelves are too few for 20
    inside = {(r["draw"], r["shelf"]) for r in many.redraws(df, "shelf", [3, 20], 4, 0).filter("inside").collect()}
    logit = lambda p: np.log(p / (1 - p))
    for r in found:
        mine = np.array([(x[1], x[2], (r["draw"], x[3]) in inside) for x in rows])
        fit, test = mine[mine[:, 2] == 1], mine[mine[:, 2] == 0]
        a, b = newton(logit(fit[:, :1]), fit[:, 1], 1e-4)
        p = {"P3": test[:, 0], "P4": 1 / (1 + np.exp(-(a * logit(test[:, 0]) + b)))}.get(r["policy"])
        if p is not None:
            assert not r["fell_back"] and abs(r["citl"] - (p.mean() - test[:, 1].mean())) < 1e-6 and r["n_recal"] == len(fit)
            bins = np.minimum((p * 15).astype(int), 14)
            assert abs(r["ece"] - sum(abs(p[bins == i].sum() - test[bins == i, 1].sum()) for i in range(15)) / len(p)) < 1e-6
