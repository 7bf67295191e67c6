import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from triagelake.llm import lexical_search as ls
from triagelake.llm.common import materialise

DOCS, ITEMS = "doc_id long, text string, term string, n int, segment int", "item_id long, text string, weight int, items int"


def terms(text):
    return re.findall(ls.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t, *_ in docs]
    big_n, big_l = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out, asked = [], {}
    for i, text, *_ in items:
        asked.setdefault(i, set()).update(terms(text))
    for i, own in asked.items():
        scored = []
        for d, bag, n in bags:
            m = 50 + 50 * n * big_n // big_l if big_l else 0
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in own if bag[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k):
    indexed = materialise(ls.index(spark.createDataFrame(docs, DOCS).repartition(3)), "index")
    return sorted(map(tuple, ls.search(indexed, spark.createDataFrame(items, ITEMS), k=k).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["The", "É́té", "x٣", "naïve", "日本", "🙂"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(2**60 + i if i % 50 else None, rng.choice([None, "", "...", "the the"]) if i % 10 == 0 else text(rng.randint(1, 60)), "t", 1, 2) for i in range(800)]
    docs += [(2000 + i % 5, "w1 w2 é copy", "", 0, 0) for i in range(300)] + [(3000, "the w7 " * 30_000, "", 0, 0)]
    items = [(i if i else None, text(12), 0, 0) for i in range(25)] + [(3, "copy", 0, 0), (90, None, 0, 0), (91, "--", 0, 0), (92, "absent", 0, 0), (93, "the", 0, 0)]
    for k in (1, 50):
        assert run(spark, docs, items, k) == brute(docs, items, k)


@pytest.mark.parametrize("docs,items", [([], [(1, "a", 0, 0)]), ([(1, "a b", "", 0, 0)], []), ([(1, None, "", 0, 0)], [(1, "a", 0, 0)]), ([(1, "a", "", 0, 0)] * 3, [(1, "A a", 0, 0)])])
def test_edges(spark, docs, items):
    assert run(spark, docs, items, 2) == brute(docs, items, 2)


def test_terms_and_numbers_in_bytes():
    import pyarrow as pa

    found, of = ls.terms_of(pa.array(["skip me", "Aa1", "bé-c", "", "d"]).slice(1))
    assert found.to_pylist() == ["aa1", "bé", "c", "d"] and of.tolist() == [0, 1, 1, 3]
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40])
    data, at = ls.pack(values)
    assert ls.unpack(data.tobytes()).tolist() == values.tolist() and at[-1] == len(data)


def test_heap_merge():
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=5)), "", 0, 0) for i in range(60)]
    lists = {t: [] for t in "abc"}
    for i, text, *_ in docs:
        for t in lists:
            if t in text:
                lists[t].append((i, text.count(t) * 7))
    own = [(max(g for _, g in p), [d for d, _ in p], [g for _, g in p]) for p in lists.values()]
    sums = Counter()
    for p in lists.values():
        for d, g in p:
            sums[d] += g
    for k in (1, 3, 200):
        assert sorted(ls.best(own, k), key=lambda x: (-x[0], x[1])) == sorted(((s, d) for d, s in sums.items()), key=lambda x: (-x[0], x[1]))[:k]
