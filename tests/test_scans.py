import random
from collections import defaultdict

from pyspark.sql import functions as F

from triagelake.operators import scans


def test_running_sums_split_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 30)}", rng.random(), i, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, p double, id long, v long")
    placed = scans.ranged(df, ["k", "p", "id"], ranges=16)
    assert placed.filter("k = 'hot'").select("__part").distinct().count() >= 8
    found = scans.running(placed, ["k"], ["p", "id"], {"n": F.lit(1), "s": F.col("v")}, placed=True).collect()
    want, seen = {}, defaultdict(lambda: [0, 0])
    for k, p, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k][0] += 1
        seen[k][1] += v or 0
        want[i] = tuple(seen[k])
    assert {r["id"]: (r["n"], r["s"]) for r in found} == want


def test_running_sums_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(i * 37 % 101, float(i)) for i in range(101)], "a long, b double")
    found = scans.running(df, [], ["a"], {"rank": F.lit(1)}).collect()
    assert all(r["rank"] == r["a"] + 1 for r in found) and len(found) == 101
    assert scans.running(df.limit(0), ["a"], ["b"], {"n": F.lit(1)}).collect() == []
