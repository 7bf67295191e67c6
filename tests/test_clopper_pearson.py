"""The exact bound of a rate, on sums of fractions, on millions of units, and as the query tries it."""

from fractions import Fraction
from math import comb, inf

import numpy as np
import pytest

from triagelake.operators import thresholds


@pytest.mark.parametrize(("n", "wrong", "rate"), [(500, 40, Fraction(1, 10)), (1, 0, Fraction(3, 10)), (2000, 230, Fraction(1, 8)), (60, 59, Fraction(19, 20)), (300, 2, Fraction(1, 100))])
def test_tail_is_the_binomial_sum(n, wrong, rate):
    want = sum(comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(wrong + 1))
    assert thresholds._beta_tail(np.array([wrong + 1.0]), np.array([float(n - wrong)]), np.array([float(rate)]))[0] == pytest.approx(float(want), rel=1e-12)


def test_millions_of_units(monkeypatch):
    calls = []
    monkeypatch.setattr(thresholds.math, "lgamma", lambda x, f=thresholds.math.lgamma: calls.append(x) or f(x))
    n = np.array([2e6, 2e6, 5.0])
    found = thresholds.clopper_pearson_upper(np.array([4e5, 0.0, 5.0]), n)
    assert found[0] == pytest.approx(0.2 + 1.6448536 * np.sqrt(0.16 / 2e6), abs=2e-6) and found[1] == pytest.approx(1 - 0.05 ** (1 / 2e6), rel=1e-6) and found[2] == 1
    assert len(calls) < 5000  # it was one for each wrong unit and step


def test_the_first_cut_above_alpha_stops(spark):
    # Accepting the scores up to 0.1 has 0 of 40 wrong, up to 0.2 it is 20 of 60, up to 0.3 20 of 2060.
    rows = [("a", 0.1, 0, 40), ("a", 0.2, 1, 20), ("a", 0.3, 0, 2000), (None, 0.5, 1, 40)]
    df = spark.createDataFrame([(e, r, y) for e, r, y, k in rows for _ in range(k)], "ev string, r double, y int")
    found = {(r["ev"], r["alpha"]): r["threshold"] for r in thresholds.risk_clopper_pearson(df, ["ev"], [0.1, 0.45, 0.01]).collect() if r["ev"]}
    assert found == {("a", 0.1): 0.1, ("a", 0.45): 0.3, ("a", 0.01): -inf}
