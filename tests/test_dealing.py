"""Groups dealt to bins without a row a group on the driver, against dealing them one by one."""

import random

import pytest

from triagelake.operators import dealing, policies


def one_by_one(sizes, shares):
    load, out = dict.fromkeys(shares, 0), {}
    for group, n in sorted(sizes, key=lambda x: (-(x[1] or 0), x[0] is not None, x[0] or "")):
        b = min(shares, key=lambda s: load[s] / shares[s])
        out[group], load[b] = b, load[b] + (n or 0)
    return out


@pytest.mark.parametrize("shares", [{"a": 3, "b": 1, "c": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 2, "c": 4, "d": 1}, {"only": 7}])
def test_dealt_as_one_by_one(spark, shares):
    rng = random.Random(len(shares))
    sizes = [(f"g{i:04}", rng.choice([1, 1, 1, 2, 3, 5, 8, 40])) for i in range(700)] + [(None, 3), ("", 3), ("nothing", 0), ("unknown", None), ("hot", 900)]
    found = dealing.dealt(spark.createDataFrame(sizes, "source string, n long"), "source", "n", shares)
    assert found.columns == ["source", "bin"]
    assert {r["source"]: r["bin"] for r in found.collect()} == one_by_one(sizes, shares)


def test_slots_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(dealing, "CHUNK", 7)
    sizes = [(f"g{i:03}", 2) for i in range(100)]
    found = dealing.dealt(spark.createDataFrame(sizes, "g string, n long"), "g", "n", {"a": 2, "b": 1})
    assert {r["g"]: r["bin"] for r in found.collect()} == one_by_one(sizes, {"a": 2, "b": 1})


def test_counts_of_equal_groups():
    for levels, steps, count in [([0, 0], [3, 3], 5), ([10, 0, 4], [2, 4, 6], 9), ([5, 5, 5], [1, 2, 3], 1), ([0, 9], [0, 0], 4)]:
        now, expected = list(levels), [0] * len(levels)
        for _ in range(count):
            b = now.index(min(now))
            now[b], expected[b] = now[b] + steps[b], expected[b] + 1
        assert dealing.taken(levels, steps, count) == expected


def test_folds_keep_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "group_id string, bin int")
    assert sorted((r["bin"], r["fold"]) for r in policies.with_folds(rows, folds=2).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert policies.with_folds(rows.filter("false")).collect() == []
