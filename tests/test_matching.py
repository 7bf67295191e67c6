"""Matches of terms by joins against a scan with a trie."""

import random

from triagelake.functions.text import TermMatcher
from triagelake.operators import matching


def test_matches_as_a_scan(spark):
    rng = random.Random(3)
    terms = ["a b", "a b c d", "b c", "c", "d d d", "e", "a  b", None, "", "c a\tb"]
    units = [(i, [rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 5, 60]))]) for i in range(80)] + [(900, None), (None, ["a", "b", "c"]), (901, ["a", "b"] * 500)]
    found = matching.term_matches(spark.createDataFrame(units, "id int, t array<string>"), ["id"], "t", spark.createDataFrame([(t, 1) for t in terms], "term string, n int"))
    scan = TermMatcher(" ".join(t.split()) for t in terms if t)
    expected = {(i, at, n) for i, t in units if t for at, n in scan.find(t)}
    rows = [(r["id"], r["start"], r["length"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_empty_lexicon_and_no_units(spark):
    units, terms = spark.createDataFrame([(1, ["a"])], "id int, t array<string>"), spark.createDataFrame([("a",)], "term string")
    assert matching.term_matches(units, ["id"], "t", terms.filter("false")).collect() == []
    assert matching.term_matches(units.filter("false"), ["id"], "t", terms).collect() == []
    assert [tuple(r) for r in matching.term_matches(units, ["id"], "t", terms).collect()] == [(1, 0, 1)]
