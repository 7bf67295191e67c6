import random

from triagelake.functions import align
from triagelake.operators import intervals


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = (rng.choices("abcde", k=rng.randint(0, 14)) for _ in range(2))
        found = align.common(a, b)
        assert len(found) == lcs(a, b) and all(a[i] == b[j] for i, j in found) and found == sorted(found)
        ops = align.lcs_operations(a, b, {"e"})
        assert [t for op, t in ops if op in "=-<"] == a and [t for op, t in ops if op in "=+>"] == b
        plain = lambda x: [t for t in x if t != "e"]
        assert sum(op == "=" for op, _ in ops) == lcs(plain(a), plain(b)) and all((t == "e") == (op in "<>") for op, t in ops)


def test_covers_against_a_loop(spark):
    rng = random.Random(3)
    spans = [(("hot", "cold", None)[min(2, int(rng.random() * 2.3))], i, float(a := rng.randint(0, 400)), float(a + rng.randint(0, 9))) for i in range(400)]
    held, new = spans[:250], spans[250:]
    frame = lambda rows: spark.createDataFrame(rows, "k string, i long, start double, end double")
    seconds = {k: {s for g, _, a, b in held if g == k for s in range(int(a), int(b))} for k in ("hot", "cold", None)}
    cover = intervals.cover_add(frame(held), ["k"])
    rows = [(r["k"], r["start"], r["end"]) for r in cover.collect()]
    assert all({s for g, a, b in rows if g == k for s in range(int(a), int(b))} == seconds[k] for k in seconds)
    for k in seconds:  # disjoint, and touching ones are one
        own = sorted((a, b) for g, a, b in rows if g == k)
        assert all(x[1] < y[0] for x, y in zip(own, own[1:]))
    found = {r["i"]: r["new_seconds"] for r in intervals.cover_marginal(frame(new), cover, ["k"], "i").collect()}
    assert found == {i: len(set(range(int(a), int(b))) - seconds[k]) for k, i, a, b in new}
