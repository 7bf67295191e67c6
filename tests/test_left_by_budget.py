"""What budgets leave, with items summed by score first: the same as in order, and few items are put in order."""

import random

import pytest
from pyspark.sql import functions as F

from triagelake.operators import detail, scans


@pytest.mark.parametrize("scores", [1, 7, 10**6])
def test_equal_to_items_in_order(spark, monkeypatch, scores):
    rng = random.Random(scores)
    rows = [(rng.choice("ab"), i, rng.randint(0, 4), rng.randint(0, 3), rng.randrange(scores)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, cost int, wrong int, s int")
    budgets, order, seen = (0.0, 0.1, 0.5, 0.99, 1.0), [F.desc("s"), "id"], []
    want = sorted(map(tuple, detail.left_by_budget(df, ["k"], order, "cost", "wrong", budgets).collect()))
    ranged = scans.ranged
    monkeypatch.setattr(scans, "ranged", lambda df, *a: seen.append(df.count()) or ranged(df, *a))
    found = detail.left_by_budget(df, ["k"], order, "cost", "wrong", budgets, "s")
    assert sorted(map(tuple, found.collect())) == want and len(want) == 10
    assert scores != 10**6 or seen[1] <= 2 * len(budgets)
