"""Matches and combinations that go through a sequence one item at a time."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.align import align, operations


def nearest_occurrences(tokens: Sequence[str], wanted: Sequence[tuple[Sequence[str], float]]) -> list[int]:
    """For each entity (tokens, expected position) the nearest start that no earlier one of as many tokens used, or -1; of equally near ones the first."""
    starts: dict[tuple[str, ...], list[int]] = {}
    for n in {len(parts) for parts, _ in wanted if len(parts)}:
        for i in range(len(tokens) - n + 1):
            starts.setdefault(tuple(tokens[i : i + n]), []).append(i)
    out = []
    for parts, expected in wanted:
        free = starts.get(tuple(parts), [])
        at = min(range(len(free)), key=lambda k: abs(free[k] - expected), default=-1)
        out.append(free.pop(at) if at >= 0 else -1)
    return out


def combined(one: Sequence[str], p1: Sequence[float], two: Sequence[str], p2: Sequence[float], take: float = 0.1, keep: float = 0.3, add: float = 0.7) -> list[str]:
    """Words of two systems: where they differ the second wins by `take`, a word that only the first has stays from `keep`, one that only the second has comes from `add`."""
    out = []
    for status, i, j in operations(align(one, two)):
        if i >= 0 and j >= 0:
            out.append(two[j] if status == "S" and p2[j] > p1[i] + take else one[i])
        elif i >= 0:
            out += [one[i]] if p1[i] >= keep else []
        elif p2[j] >= add:
            out.append(two[j])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def combine_words(one: pd.Series, p1: pd.Series, two: pd.Series, p2: pd.Series) -> pd.Series:
    return pd.Series([combined(list(a), list(b), list(c), list(d)) for a, b, c, d in zip(one, p1, two, p2, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("hyp", T.StringType())])))
def diff_rows(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """The alignment as rows to show: op, ref, hyp."""
    show = lambda r, h: [{"op": s, "ref": r[i] if i >= 0 else None, "hyp": h[j] if j >= 0 else None} for s, i, j in operations(align(r, h))]
    return pd.Series([show(list(r), list(h)) for r, h in zip(ref, hyp, strict=True)])
