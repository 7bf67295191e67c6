"""The mix against resharing by hand, and its promises."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from triagelake.llm import mixing


def by_hand(sizes, weights, ratio, cap):
    """Targets by resharing the excess over and over. sizes: source to words."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), ratio * sum(sizes.values())
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weight[s] / whole > cap * sizes[s]}
        share = left
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s] / whole
            if s in over:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken_words(spark, docs_schema, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = None if rng.random() < 0.05 else "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "é", "Z", "empty"])
        n = 0 if source == "empty" else rng.choice([0, 1, 3, 50, 400])
        rows.append((i, None if n == 0 and rng.random() < 0.5 else " \t".join(["w"] * n), "en", source, 0))
    found = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, docs_schema)).collect()]
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == len((rows[r["doc_id"]][1] or "").split())
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
    expected = by_hand(sizes, (3, 1, 2), 1.5, 2.0)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s], abs=1e-3)
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    first = [r["positions"][0] for r in found if r["positions"]]
    assert first == sorted(first)


def test_positions_follow_the_schedule(spark, docs_schema):
    rows = [(i, "w " * 10, "en", s, 0) for s in ("a", "b", "c") for i in range({"a": 0, "b": 1000, "c": 2000}[s], {"a": 0, "b": 1000, "c": 2000}[s] + 500)]
    found = mixing.mix(spark.createDataFrame(rows, docs_schema)).withColumn("p", F.explode("positions")).collect()
    for low, knots in ((0, mixing.SCHEDULES[0]), (1000, mixing.SCHEDULES[1]), (2000, mixing.SCHEDULES[2])):
        at = sorted(r["p"] for r in found if low <= r["doc_id"] < low + 1000)
        area = lambda t: sum((min(t, b) - a) * (wa + wa + (wb - wa) * (min(t, b) - a) / (b - a)) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a)  # noqa: B023, E731
        for i, t in enumerate(at):
            assert area(t) / area(1.0) == pytest.approx((i + 0.5) / len(at), abs=0.01)


def test_training_order_repeats_documents_and_keeps_columns(spark, docs_schema):
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 5), (2, "d", None, "x", 1), (3, None, "en", None, 0), (None, "e f", "en", "y", 3)], docs_schema)
    mixed = mixing.mix(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    order = mixing.training_order(docs, mixed)
    assert order.columns == docs.columns
    got = [r["doc_id"] for r in order.collect()]
    assert {d: got.count(d) for d in copies} == copies


def test_edge_tables(spark, docs_schema):
    empty = spark.createDataFrame([], docs_schema)
    assert mixing.mix(empty).collect() == []
    nothing = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "a", 0)], docs_schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0), (0, 0.0, 0)]
    clash = spark.createDataFrame([(1, "a", "s", 7, 8)], "doc_id long, text string, source string, size int, bucket int")
    assert [r["taken"] for r in mixing.mix(clash).collect()] in ([1], [2])
