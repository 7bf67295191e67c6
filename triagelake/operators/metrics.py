"""Ranking, calibration and decision metrics over (keys, p, y) rows, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators import scans

Keys = Sequence[str]


def ratio(num: Column, den: Column) -> Column:
    """Sum over sum, null where the denominator is 0 or there are no rows."""
    return F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double"))


def bin_of(p: Column, bins: int) -> Column:
    """Equal-width bin of p in [0, 1]; p = 1 goes to the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, keys: Keys, bins: int = 15, p: str = "r", y: str = "y") -> DataFrame:
    """Per bin that has rows: n, mean_p, frac_err, lo, hi."""
    return (
        df.groupBy(*keys, bin_of(F.col(p), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("frac_err"))
        .withColumn("lo", F.col("bin") / F.lit(float(bins)))
        .withColumn("hi", (F.col("bin") + 1) / F.lit(float(bins)))
    )


def ece(df: DataFrame, keys: Keys, bins: int = 15, p: str = "r", y: str = "y") -> DataFrame:
    """Expected calibration error."""
    parts = reliability(df, keys, bins, p, y)
    return parts.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frac_err"))) / F.sum("n")).alias("ece"))


def calibration(df: DataFrame, keys: Keys, p: str = "r", y: str = "y", eps: float = 1e-6) -> DataFrame:
    """Brier score, calibration in the large (mean p less mean y) and clipped log loss."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return df.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), (F.avg(p) - F.avg(y)).alias("citl"), F.avg(loss).alias("logloss"))


def _by_score(df: DataFrame, keys: Keys, p: str, y: str) -> DataFrame:
    """Rows and positives of each distinct score: what rank metrics need, and no larger than the scores are."""
    return df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))


def _with_totals(df: DataFrame, keys: Keys, totals: dict[str, Column]) -> DataFrame:
    """Adds sums over the whole key, aggregated first and joined."""
    found = df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in totals.items()))
    return df.join(found, list(keys)) if keys else df.crossJoin(found)  # without keys, a single row


def auroc(df: DataFrame, keys: Keys, p: str = "r", y: str = "y") -> DataFrame:
    """Mann-Whitney with mid-ranks; null with one class. Negatives below each distinct score are a running sum over ranges of scores."""
    negative = F.col("n") - F.col("pos")
    scored = scans.running(_by_score(df, keys, p, y), keys, [p], {"upto": negative})
    wins = F.col("pos") * (F.col("upto") - negative + negative / F.lit(2.0))
    return scored.groupBy(*keys).agg(F.try_divide(F.sum(wins), (F.sum("pos") * F.sum(negative)).cast("double")).alias("auroc"))


def precision_recall(df: DataFrame, keys: Keys, p: str = "r", y: str = "y") -> DataFrame:
    """Precision and recall of flagging scores of at least each distinct value."""
    out = scans.running(_by_score(df, keys, p, y), keys, [F.col(p).desc()], {"tp": F.col("pos"), "flagged": F.col("n")})
    out = _with_totals(out, keys, {"all_pos": F.col("pos")})
    return out.select(*keys, p, "pos", (F.col("tp") / F.col("flagged")).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")).alias("recall"), "all_pos")


def auprc(df: DataFrame, keys: Keys, p: str = "r", y: str = "y") -> DataFrame:
    """Average precision, and the threshold of the best F1 (the largest such)."""
    pr = precision_recall(df, keys, p, y)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    step = F.col("precision") * F.try_divide(F.col("pos").cast("double"), F.col("all_pos").cast("double"))
    return pr.withColumn("f1", F.coalesce(f1, F.lit(0.0))).groupBy(*keys).agg(F.sum(step).alias("auprc"), F.max("f1").alias("best_f1"), F.max(F.struct(F.round("f1", 12).alias("f"), F.col(p).alias("t"))).getField("t").alias("best_threshold"))


def risk_coverage(df: DataFrame, keys: Keys, p: str = "r", loss: str = "y", weight: str | None = None, tie: str = "unit_id") -> DataFrame:
    """Accepting in increasing risk, ties by `tie`: coverage and cumulative (weighted) risk at each row, by running sums over ranges."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.select(*keys, tie, p, (F.col(loss) * w).alias("__loss"), w.alias("__w"))
    upto = scans.running(rows, keys, [p, tie], {"__rank": F.lit(1), "__lost": F.col("__loss"), "__weight": F.col("__w")})
    whole = _with_totals(upto, keys, {"__all": F.lit(1)})
    return whole.select(*keys, tie, p, (F.col("__rank") / F.col("__all")).alias("coverage"), F.try_divide(F.col("__lost").cast("double"), F.col("__weight").cast("double")).alias("risk"))


def aurc(df: DataFrame, keys: Keys, p: str = "r", loss: str = "y", tie: str = "unit_id") -> DataFrame:
    """Mean selective risk; with the oracle's, which accepts right units first and few errors before many."""
    own = risk_coverage(df, keys, p, loss, tie=tie).groupBy(*keys).agg(F.avg("risk").alias("aurc"))
    best = risk_coverage(df.withColumn("__best", F.col(loss) + F.lit(1e-9) * F.col("errors")), keys, "__best", loss, tie=tie)
    return own.join(best.groupBy(*keys).agg(F.avg("risk").alias("aurc_oracle")), list(keys))


def confusion(df: DataFrame, keys: Keys, threshold: float, p: str = "r", y: str = "y") -> DataFrame:
    """Counts and rates of flagging p >= threshold."""
    flag, pos = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.groupBy(*keys).agg(n(flag & pos).alias("tp"), n(flag & ~pos).alias("fp"), n(~flag & pos).alias("fn"), n(~flag & ~pos).alias("tn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": d(tp + tn, tp + fp + fn + tn), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "specificity": d(tn, tn + fp), "f1": d(2 * tp, 2 * tp + fp + fn), "flagged_share": d(tp + fp, tp + fp + fn + tn)})


def operating_points(decided: DataFrame, keys: Keys) -> DataFrame:
    """Outcomes of decisions (review boolean) on units with y, crit, r, errors, n_ref; null where a set is empty."""
    acc, rev = ~F.col("review"), F.col("review")
    when = lambda cond, c: F.when(cond, F.col(c))
    total = lambda c: F.sum(c).cast("double")
    return decided.groupBy(*keys).agg(
        F.avg(rev.cast("double")).alias("review_rate"),
        F.try_divide(total(when(rev, "y")), total(F.col("y"))).alias("err_caught"),
        F.avg(when(acc, "y")).alias("accepted_err_rate"),
        F.try_divide(total(when(acc, "errors")), total(when(acc, "n_ref"))).alias("accepted_wer"),
        F.try_divide(total(when(rev, "errors")), total(F.col("errors"))).alias("word_errors_caught"),
        F.coalesce(F.sum(when(acc, "y")), F.lit(0)).alias("n_accepted_errors"),
        F.avg(when(acc, "r")).alias("pred_accepted_err"),
        F.avg(when(acc, "crit")).alias("accepted_crit_err_rate"),
        F.try_divide(total(when(rev, "crit")), total(F.col("crit"))).alias("crit_caught"),
    )
