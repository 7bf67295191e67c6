"""Alignment of token lists with zero-cost wildcards.

A wildcard in the reference stands for any run of hypothesis tokens. Statuses are C, S, D, W for reference tokens and
C, S, I, W for hypothesis tokens. Of equally cheap paths the one is taken that, read from the end, prefers a diagonal step
to a deletion and that to an insertion; a wildcard takes as few tokens as it can.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.text import WILDCARD, collapsed, reference_tokens, scoring_tokens


def _arrays(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()])


ALIGNED = _arrays(ref_status=T.StringType(), hyp_status=T.StringType(), ref_to_hyp=T.IntegerType(), wild_runs=T.IntegerType())


@dataclass
class Alignment:
    ref_status: list[str]
    hyp_status: list[str]
    ref_to_hyp: list[int]
    wild_runs: list[int]


def align(ref: Sequence[str], hyp: Sequence[str]) -> Alignment:
    n, m = len(ref), len(hyp)
    codes = {t: i for i, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = np.array([codes[t] for t in hyp], np.int64)
    cost = np.zeros((n + 1, m + 1), np.int64)
    steps = np.arange(m + 1)
    cost[0] = steps
    for i, token in enumerate(ref, 1):
        above = cost[i - 1]
        if token == WILDCARD:
            cost[i] = np.minimum.accumulate(above)
        else:
            best = above + 1
            best[1:] = np.minimum(best[1:], above[:-1] + (h != codes[token]))
            cost[i] = np.minimum.accumulate(best - steps) + steps
    out = Alignment(["D"] * n, ["I"] * m, [-1] * n, [])
    i, j = n, m
    while i or j:
        if i and ref[i - 1] == WILDCARD:
            first = j
            while cost[i - 1, first] != cost[i, j]:
                first -= 1
            out.ref_status[i - 1] = "W"
            out.hyp_status[first:j] = ["W"] * (j - first)
            out.wild_runs.append(j - first)
            i, j = i - 1, first
        elif i and j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.ref_status[i] = out.hyp_status[j] = "C" if ref[i] == hyp[j] else "S"
            out.ref_to_hyp[i] = j
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    out.wild_runs.reverse()
    return out


@F.pandas_udf(ALIGNED)
def aligned(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """The alignment of two token arrays as a struct."""
    rows = [align([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(ref, hyp, strict=True)]
    return pd.DataFrame({name: [getattr(a, name) for a in rows] for name in ("ref_status", "hyp_status", "ref_to_hyp", "wild_runs")})


def counts(a: Column) -> dict[str, Column]:
    """n_ref, hits, subs, dels, ins, absorbed, errors, wer and wild_excess of an alignment struct."""
    of = lambda side, s: F.size(F.filter(a[side], lambda x: x == s))
    subs, dels, ins = of("ref_status", "S"), of("ref_status", "D"), of("hyp_status", "I")
    n_ref, errors = F.size(F.filter(a["ref_status"], lambda x: x != "W")), subs + dels + ins
    return {
        "n_ref": n_ref, "hits": of("ref_status", "C"), "subs": subs, "dels": dels, "ins": ins, "absorbed": of("hyp_status", "W"), "errors": errors,
        "wer": F.try_divide(errors.cast("double"), n_ref.cast("double")), "wild_excess": F.aggregate(a["wild_runs"], F.lit(0), lambda s, r: s + F.greatest(r - 3, F.lit(0))),
    }


def score_units(records: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Decoder records (key, text) of any system scored against references (key, reference): (key, n_ref, hits, ..., wer).

    Units without a record count as empty transcripts; records without a reference are left out.
    """
    both = references.select(key, collapsed(reference_tokens(F.col("reference"))).alias("ref")).join(records.select(key, scoring_tokens(F.col("text")).alias("hyp")), key, "left")
    scored = both.withColumn("a", aligned("ref", "hyp"))
    return scored.select(key, *(c.alias(name) for name, c in counts(F.col("a")).items()))


def distance(ref: Sequence[str], hyp: Sequence[str]) -> int:
    """Edits between token lists without wildcards; two rows of the table at a time, so memory grows with one list only."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(t, len(codes)) for t in side], np.int64) for side in (ref, hyp))
    steps = np.arange(len(b) + 1)
    row = steps
    for token in a:
        best = row + 1
        np.minimum(best[1:], row[:-1] + (b != token), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def edit_count(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edits between token arrays without wildcards, of any length and with any number of different tokens; null where one is null."""
    return pd.Series([None if r is None or h is None else distance(r, h) for r, h in zip(ref, hyp, strict=True)], dtype="Int32")


def wildcard_cost(ref: Column, hyp: Column) -> Column:
    """Edits with wildcards, natively: rows of the table by a fold over the reference."""
    start = F.sequence(F.lit(0), F.size(hyp))

    def row(above: Column, token: Column) -> Column:
        wild = F.transform(above, lambda v, j: F.array_min(F.slice(above, F.lit(1), j + 1)))
        best = F.transform(above, lambda v, j: F.when(j == 0, v + 1).otherwise(F.least(v + 1, F.try_element_at(above, j) + F.when(F.try_element_at(hyp, j) == token, 0).otherwise(1))) - j)
        plain = F.transform(best, lambda v, j: F.array_min(F.slice(best, F.lit(1), j + 1)) + j)
        return F.when(token == WILDCARD, wild).otherwise(plain)

    return F.element_at(F.aggregate(ref, start, row), -1)


def operations(a: Alignment) -> list[tuple[str, int, int]]:
    """(status, reference position, hypothesis position) in order; -1 where a side has none."""
    out, j = [], 0
    for i, status in enumerate(a.ref_status):
        if status in "CS":
            while j < a.ref_to_hyp[i]:
                out.append((a.hyp_status[j], -1, j))
                j += 1
            out.append((status, i, j))
            j += 1
        else:
            if status == "W":
                while j < len(a.hyp_status) and a.hyp_status[j] == "I":
                    out.append(("I", -1, j))
                    j += 1
            out.append((status, i, -1))
            if status == "W":
                run = sum(s == "W" for s in a.ref_status[: i + 1]) - 1
                for _ in range(a.wild_runs[run]):
                    out.append(("W", -1, j))
                    j += 1
    return out + [(a.hyp_status[k], -1, k) for k in range(j, len(a.hyp_status))]


@F.pandas_udf(_arrays(word_loss=T.DoubleType(), gap_loss=T.DoubleType()))
def losses(ref: pd.Series, hyp: pd.Series, ref_weight: pd.Series, hyp_weight: pd.Series) -> pd.DataFrame:
    """Weighted error fixed by checking each hypothesis token and each gap: a substitution costs its heavier side, a deletion its gap."""
    words, gaps = [], []
    for r, h, rw, hw in zip(ref, hyp, ref_weight, hyp_weight, strict=True):
        word, gap, at = np.zeros(len(h)), np.zeros(len(h) + 1), 0
        for status, i, j in operations(align(list(r), list(h))):
            if status == "S":
                word[j] = max(rw[i], hw[j])
            elif status == "I":
                word[j] = hw[j]
            elif status == "D":
                gap[at] += rw[i]
            at = j + 1 if j >= 0 else at
        words.append(word), gaps.append(gap)
    return pd.DataFrame({"word_loss": words, "gap_loss": gaps})


@F.pandas_udf(_arrays(agree=T.IntegerType(), extra=T.IntegerType()))
def second_opinion(hyp: pd.Series, other: pd.Series) -> pd.DataFrame:
    """Where another transcript agrees with each token, and how many tokens more it has in each gap (longest matching blocks first)."""
    agree, extra = [], []
    for h, o in zip(hyp, other, strict=True):
        yes, more = np.zeros(len(h), np.int32), np.zeros(len(h) + 1, np.int32)
        for tag, a, b, c, d in difflib.SequenceMatcher(None, list(h), list(o), autojunk=False).get_opcodes():
            yes[a:b] = tag == "equal"
            if tag in ("insert", "replace"):
                more[b] += max(0, (d - c) - (b - a))
        agree.append(yes), extra.append(more)
    return pd.DataFrame({"agree": agree, "extra": extra})


def common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, by rows of bits.

    Bit i of row j is 0 where one more token of a, the one at i, makes the longest common subsequence with the first j tokens of b longer by one. A row takes a few
    operations on whole numbers of len(a) bits; rows are kept to walk back.
    """
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    every = (1 << len(a)) - 1
    rows = [every]
    for token in b:
        row = rows[-1]
        hit = row & places.get(token, 0)
        rows.append(((row + hit) | (row - hit)) & every)
    i, j, found = len(a), len(b), []
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def lcs_operations(a: Sequence[str], b: Sequence[str], fillers: Collection[str]) -> list[tuple[str, str]]:
    """(op, token) in order: = in both, - in a alone, + in b alone; fillers take no part and are < in a and > in b. Tokens with =, - and < are a, those with =, + and > are b."""
    mine, theirs = ([i for i, t in enumerate(x) if t not in fillers] for x in (a, b))
    out, i, j = [], 0, 0
    alone = lambda t, sign, filler: (filler if t in fillers else sign, t)
    for x, y in [*((mine[p], theirs[q]) for p, q in common([a[k] for k in mine], [b[k] for k in theirs])), (len(a), len(b))]:
        out += [alone(t, "-", "<") for t in a[i:x]] + [alone(t, "+", ">") for t in b[j:y]]
        out += [("=", a[x])] if x < len(a) else []
        i, j = x + 1, y + 1
    return out


def lcs_diff(fillers: Collection[str]) -> Callable[[Column, Column], Column]:
    """A function of two arrays of tokens that gives their lcs_operations; a null array is empty."""
    kept = frozenset(fillers)
    kind = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("token", T.StringType())]))

    @F.pandas_udf(kind)
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": op, "token": t} for op, t in lcs_operations(*([] if x is None else list(x) for x in both), kept)] for both in zip(a, b, strict=True)])

    return diff
