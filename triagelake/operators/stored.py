"""Policies as they are stored: JSON lines that say how to score a unit and from which score on a human reviews it at each point."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators import detail, policies, thresholds


@dataclass(frozen=True)
class Policy:
    """A linear score of features, feature to (mean, scale, coefficient), or a column that holds the risk (`raw`); `platt` recalibrates a set's probabilities.

    Thresholds are by set that they were tuned on and point, and a unit at its threshold is reviewed.
    """

    name: str
    label: str
    probabilistic: bool
    tuned_on: str
    raw: str | None = None
    features: Mapping[str, tuple[float, float, float]] = field(default_factory=dict)
    intercept: float = 0.0
    platt: tuple[float, float] | None = None
    thresholds: Mapping[str, float] = field(default_factory=dict)

    def risk(self) -> Column:
        """The unit's risk; null where a feature is."""
        score = F.col(self.raw).cast("double") if self.raw else policies.linear_score(self.features, self.intercept)
        return policies.platt(score, *self.platt) if self.platt else score


def tuned(policy: Policy, units: DataFrame, budgets: Iterable[float], alphas: Iterable[float], ev: str = "ev", y: str = "y") -> Policy:
    """The policy with thresholds from the set that it is tuned on: budgets, and for probabilities risk targets. A `>` rule becomes the `>=` rule of the next
    double; a target that no cut meets reviews everything; a set without units gives no thresholds."""
    own = units.filter(F.col(ev) == policy.tuned_on)
    found = detail.points(own, {policy.name: policy.risk()}, tuple(budgets), tuple(alphas) if policy.probabilistic else (), ev, y).collect()  # a row a point
    at = {r["point"]: r["threshold"] if r["inclusive"] else thresholds.as_inclusive(r["threshold"]) for r in found}
    return Policy(**{**asdict(policy), "thresholds": dict(sorted(at.items()))})


def export(spark: SparkSession, found: Iterable[Policy], path: str) -> None:
    """One JSON line a policy; doubles keep all their digits, and columns of units are not written."""
    lines = [(json.dumps(asdict(p), ensure_ascii=False, allow_nan=False),) for p in found]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str) -> list[Policy]:
    """The policies by name; an unknown field is an error."""
    known = [Policy(**json.loads(r["value"])) for r in spark.read.text(path).collect()]  # a handful of policies
    return sorted(known, key=lambda p: p.name)


def decided(units: DataFrame, known: Iterable[Policy]) -> DataFrame:
    """The units at every policy and point: policy, point, risk, review. Units without a risk are left out of that policy."""
    of = lambda p: F.array(*(F.struct(F.lit(p.name).alias("policy"), F.lit(point).alias("point"), p.risk().alias("risk"), (p.risk() >= F.lit(t)).alias("review")) for point, t in p.thresholds.items()))
    rows = [of(p) for p in known if p.thresholds]
    if not rows:
        return units.select("*", F.lit("").alias("policy"), F.lit("").alias("point"), F.lit(0.0).alias("risk"), F.lit(False).alias("review")).filter("false")
    return units.select("*", F.explode(F.concat(*rows)).alias("__d")).select(*units.columns, "__d.*").filter("risk IS NOT NULL")
