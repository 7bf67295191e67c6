"""Boosted Poisson trees against plain numpy, cross-fitting, and what reaches the driver."""

import os

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators import boosting
from triagelake.operators.boosting import Settings

FOLDER = "/root/testdata/sf0.001"


def plain(x, y, edges, s):
    """Gradient boosting by trying every cut of every feature on the rows themselves."""
    codes = np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c)) for c, e in zip(x.T, edges)], 1)
    raw = np.full(len(y), np.log(y.mean()))

    def grow(rows, depth):
        g, h = np.exp(raw[rows]) - y[rows], np.exp(raw[rows])
        tries = []
        for f in range(x.shape[1]) if depth else []:
            for cut in range(1, len(edges[f]) + 2):
                for side in (0, 1):
                    c = codes[rows, f]
                    left = np.where(c == 0, bool(side), c <= cut)
                    if left.sum() >= s.min_leaf and (~left).sum() >= s.min_leaf:
                        q = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
                        tries.append((q(left) + q(~left) - g.sum() ** 2 / (h.sum() + s.l2), left))
        most = max((t[0] for t in tries), default=0)
        if most <= 1e-10:
            step[rows] = -s.rate * g.sum() / (h.sum() + s.l2) if depth < s.depth else 0
            return
        left = next(m for gain, m in tries if gain >= most * (1 - 1e-9))
        grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    for _ in range(s.trees):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), s.depth)
        raw = raw + step
    return np.exp(raw)


def table(spark, rows=700, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.random(rows), rng.integers(0, 4, rows).astype(float), rng.random(rows).round(1)
    y = rng.poisson(np.exp(1.5 * (a > 0.6) + 0.5 * (b == 2) - 1))
    a[rng.random(rows) < 0.2] = np.nan
    group = rng.integers(0, 23, rows)
    data = [(i, None if np.isnan(p) else float(p), float(q), float("nan") if r == 0.3 else float(r), int(n), f"g{g}") for i, (p, q, r, n, g) in enumerate(zip(a, b, c, y, group))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y int, grp string").repartition(3)


def test_equal_to_plain_boosting(spark):
    df, s = table(spark), Settings(trees=10, depth=3, rate=0.3, min_leaf=15)
    edges = boosting.bin_edges(df, ["a", "b", "c"], 24)
    (model,) = boosting.fit(df, ["a", "b", "c"], "y", settings=s, edges=edges)
    found = boosting.predict(df, [model], "p").toPandas().sort_values("id")
    want = plain(found[["a", "b", "c"]].to_numpy(float), found["y"].to_numpy(float), edges, s)
    assert len(model.trees) == 10 and np.allclose(found["p"], want, rtol=1e-9)
    assert ((found["p"] - found["y"]) ** 2).mean() < 0.8 * found["y"].var()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_equal_to_plain_boosting_on_the_word_tables(spark):
    from triagelake.plans import queries_verifier as q

    words, _ = q.training_tables(spark, FOLDER)
    names, s = ["p", "own_w", "agree", "other_w", "dis_run", "other_p"], Settings(trees=3, depth=2, rate=0.2, min_leaf=40)
    edges = boosting.bin_edges(words, names, 12)
    (model,) = boosting.fit(words, names, "b", settings=s, edges=edges)
    found = boosting.predict(words, [model], "got").toPandas()
    assert found[names].isna().any().any() and len(found) > 1000
    assert np.allclose(found["got"], plain(found[names].to_numpy(float), found["b"].to_numpy(float), edges, s), rtol=1e-8)


def test_no_group_is_scored_by_a_model_that_saw_it(spark):
    # The only feature tells the group, and each group has a mean of its own: only a model that saw a group can know it.
    rows = [(g, float(g), 50 * (g % 2), f"c{g}") for g in range(20) for _ in range(30)]
    df = spark.createDataFrame(rows, "g int, x double, y int, cons string").repartition(2)
    s = Settings(trees=3, depth=4, rate=0.5, min_leaf=1)
    found = boosting.cross_fitted(df, ["x"], "y", "cons", "p", folds=4, seed=3, settings=s)
    per_fold = found.groupBy("fold").agg(F.countDistinct("cons").alias("n")).collect()
    assert sorted(r["n"] for r in per_fold) == [5, 5, 5, 5] and found.groupBy("cons").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    split = found.select("g", "x", "y", "cons", "fold").toPandas()
    models = boosting.fit(found, ["x"], "y", settings=s, folds=4, fold="fold")
    for k, model in list(enumerate(models))[:2]:
        alone = boosting.fit(df.join(spark.createDataFrame(split[split.fold != k][["cons"]].drop_duplicates()), "cons"), ["x"], "y", settings=s, edges=model.edges)[0]
        bins = boosting.binned(model.edges, [np.arange(20.0)])
        assert np.allclose(model.raw(bins), alone.raw(bins))
    assert boosting.permuted_folds(df, "cons", 4, 3).collect() != boosting.permuted_folds(df, "cons", 4, 4).collect()


def test_only_sums_reach_the_driver(spark, monkeypatch):
    df, seen = table(spark, 6000).select((F.floor(F.col("a") * 5) / 5).alias("a"), "b", "y"), []
    frame = type(df)
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): (lambda out: seen.append(len(out)) or out)(f(self)))
    boosting.fit(df, ["a", "b"], "y", settings=Settings(trees=2, depth=2))
    assert seen and max(seen) <= 2 * 2 * 8 + 1 and isinstance(df, DataFrame)


def test_early_stopping_and_edges(spark):
    df = table(spark)
    (model,) = boosting.fit(df.withColumn("noise", F.rand(1)), ["noise"], "y", settings=Settings(trees=40, depth=3, rate=0.9, l2=0.0, min_leaf=2, patience=3), key=["id"])
    assert len(model.trees) < 40
    for rows in (df.limit(0), df.withColumn("y", F.lit(0)), df.withColumn("a", F.lit(None).cast("double"))):
        (model,) = boosting.fit(rows, ["a"], "y", settings=Settings(trees=2, depth=2))
        assert all(r["p"] >= 0 for r in boosting.predict(rows, [model], "p").collect())
