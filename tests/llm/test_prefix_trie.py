import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from triagelake.llm.prefix_trie import numbered, rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string, n int, j int, key string"


def rebuild(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    found = {}
    for node, of in members.items():
        under = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under) for n in under)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(map(str, sorted(c for c in of if len(convs[c]) == len(node))))
        children = sum(len(n) == len(node) + 1 for n in under)
        found[min(of), len(node)] = (min(members[node[:-1]]) if node else None, len(of), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest(), len(under))
    return found


def check(found, convs):
    want = brute(convs)
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, r.place_end - r.place + 1) for r in found} == want
    assert sorted(r.place for r in found) == list(range(1, len(want) + 1))


def test_rebuilt_conversations(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "bb", None, ""]), 1, 2, "k") for c in rng.sample(range(120), 70) for _ in range(rng.randint(1, 14))]
    turns, convs = rebuilt(spark.createDataFrame(rows, SCHEMA))
    check(trie(turns, convs).collect(), rebuild(rows))


def test_hot_first_turn_copies_prefixes_and_a_long_conversation(spark):
    rng = random.Random(9)
    rows = [(c, t, "user", "hi" if t == 0 else rng.choice("xy"), 0, 0, "") for c in range(100) for t in range(1 + c % 7)]
    rows += [(c, t, "user", "copy", 0, 0, "") for c in range(200, 260) for t in range(3)]
    rows += [(300, t, "user", f"t{t % 3}", 0, 0, "") for t in range(400)] + [(301, t, "user", f"t{t % 3}" if t < 350 else "z", 0, 0, "") for t in range(360)]
    df = spark.createDataFrame(rows, SCHEMA)
    convs = defaultdict(list)
    for c, _, role, text, *_ in rows:
        convs[c].append((role, text))
    check(trie(numbered(df), df.select("conv_id").distinct()).collect(), convs)


@pytest.mark.parametrize("rows", [[], [(7, None, None, None, 0, 0, "")], [(3, 1, "user", "a", 0, 0, "")] * 3 + [(None, 1, "user", "b", 0, 0, ""), (-2, 0, "u", "", 0, 0, "")]])
def test_edges(spark, rows):
    turns, convs = rebuilt(spark.createDataFrame(rows, SCHEMA))
    found = trie(turns, convs).collect()
    if not rows:
        assert found == []
    elif rows[0][0] == 7:  # h turns of nothing, and its only turn is among its own first h
        assert [(r.depth, r.n_leaves) for r in found] == ([(0, 1)] if zlib.crc32(b"7") % 9 else [(0, 1), (1, 1)])
    else:
        assert found and all(r.place <= r.place_end for r in found)
