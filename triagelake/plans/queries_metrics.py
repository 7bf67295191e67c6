"""Queries on scored units: metrics, thresholds, decisions, bootstrap and tests."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.operators import bootstrap, many, metrics, policies, quantiles, scans, thresholds, windows
from triagelake.plans.registry import DEALT, Registry, drawn_sql, rounded
from triagelake.plans.views import UNITS, WORDS, units, words
from triagelake.sources import records

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add
BUDGETS, ALPHAS = (0.01, 0.05, 0.10, 0.20, 0.30), (0.1, 0.2, 0.3)


@query("agg_ece", UNITS, """SELECT ev, round(sum(n * abs(mp - fy)) / sum(n), 6) AS ece FROM (
  SELECT ev, least(floor(r * 15), 14) AS b, count(*) AS n, avg(r) AS mp, avg(y) AS fy FROM units GROUP BY ALL) GROUP BY ev""")
def agg_ece(spark, d):
    return rounded(metrics.ece(units(spark, d), ["ev"]))


@query("agg_reliability", UNITS, """SELECT ev, CAST(least(floor(r * 15), 14) AS INT) AS bin, count(*) AS n, round(avg(r), 6) AS mean_p, round(avg(y), 6) AS frac_err,
  round(CAST(least(floor(r * 15), 14) AS INT) / 15.0::DOUBLE, 6) AS lo, round((CAST(least(floor(r * 15), 14) AS INT) + 1) / 15.0::DOUBLE, 6) AS hi FROM units GROUP BY ev, least(floor(r * 15), 14)""")
def agg_reliability(spark, d):
    return rounded(metrics.reliability(units(spark, d), ["ev"]))


def _calibration(column):
    return lambda spark, d: rounded(metrics.calibration(units(spark, d), ["ev"]).select("ev", column))


query("agg_brier", UNITS, "SELECT ev, round(avg((r - y) * (r - y)), 6) AS brier FROM units GROUP BY ev")(_calibration("brier"))
query("agg_citl", UNITS, "SELECT ev, round(avg(r) - avg(y), 6) + 0.0 AS citl FROM units GROUP BY ev")(_calibration("citl"))
query("agg_logloss", UNITS, """SELECT ev, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS logloss
  FROM (SELECT ev, y, least(greatest(r, 1e-6), 1 - 1e-6) AS q FROM units) GROUP BY ev""")(_calibration("logloss"))


@query("agg_auroc", UNITS, """SELECT ev, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE, 6) AS auroc FROM (
  SELECT ev, y, rank() OVER (PARTITION BY ev ORDER BY r) + (count(*) OVER (PARTITION BY ev, r) - 1) / 2.0::DOUBLE AS rk FROM units) GROUP BY ev""")
def agg_auroc(spark, d):
    return rounded(metrics.auroc(units(spark, d), ["ev"]))


_PR = UNITS + """, pr AS (SELECT ev, r, pos, tp / fl::DOUBLE AS prec, tp / nullif(al, 0)::DOUBLE AS rec, al FROM (
  SELECT ev, r, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS fl, sum(pos) OVER (PARTITION BY ev) AS al
  FROM (SELECT ev, r, count(*) AS n, sum(y) AS pos FROM units GROUP BY ev, r) WINDOW w AS (PARTITION BY ev ORDER BY r DESC))),
f AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1 FROM pr)"""


@query("agg_auprc", _PR, """SELECT ev, round(sum(prec * pos / nullif(al, 0)::DOUBLE), 6) AS auprc, round(max(f1), 6) AS best_f1,
  round(max(CASE WHEN round(f1, 12) = m THEN r END), 6) AS best_threshold FROM (SELECT *, max(round(f1, 12)) OVER (PARTITION BY ev) AS m FROM f) GROUP BY ev""")
def agg_auprc(spark, d):
    return rounded(metrics.auprc(units(spark, d), ["ev"]))


@query("win_risk_coverage", UNITS, """SELECT ev, unit_id, round(r, 6) AS r, round(row_number() OVER w / count(*) OVER (PARTITION BY ev)::DOUBLE, 6) AS coverage, round(avg(y) OVER w, 6) AS risk
  FROM units WINDOW w AS (PARTITION BY ev ORDER BY r, unit_id ROWS UNBOUNDED PRECEDING)""")
def win_risk_coverage(spark, d):
    return rounded(metrics.risk_coverage(units(spark, d), ["ev"]))


@query("win_aurc", UNITS, """SELECT a.ev, aurc, aurc_oracle FROM
  (SELECT ev, round(avg(k), 6) AS aurc FROM (SELECT ev, avg(y) OVER (PARTITION BY ev ORDER BY r, unit_id ROWS UNBOUNDED PRECEDING) AS k FROM units) GROUP BY ev) a JOIN
  (SELECT ev, round(avg(k), 6) AS aurc_oracle FROM (SELECT ev, avg(y) OVER (PARTITION BY ev ORDER BY y, errors, unit_id ROWS UNBOUNDED PRECEDING) AS k FROM units) GROUP BY ev) b ON a.ev = b.ev""")
def win_aurc(spark, d):
    return rounded(metrics.aurc(units(spark, d), ["ev"]))


@query("win_oracle_rank", UNITS, "SELECT ev, unit_id, row_number() OVER (PARTITION BY ev ORDER BY y, errors, unit_id) AS rank FROM units")
def win_oracle_rank(spark, d):
    best = F.col("y") + F.lit(1e-9) * F.col("errors")
    return scans.running(units(spark, d).select("ev", "unit_id", best.alias("best")), ["ev"], ["best", "unit_id"], {"rank": F.lit(1)}).select("ev", "unit_id", F.col("rank").cast("long").alias("rank"))


@query("agg_confusion_at", UNITS, """SELECT ev, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS "precision",
  round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) AS flagged_share
  FROM (SELECT ev, count(*) FILTER (r >= 0.5 AND y = 1) AS tp, count(*) FILTER (r >= 0.5 AND y = 0) AS fp, count(*) FILTER (r < 0.5 AND y = 1) AS fn, count(*) FILTER (r < 0.5 AND y = 0) AS tn FROM units GROUP BY ev)""")
def agg_confusion_at(spark, d):
    return rounded(metrics.confusion(units(spark, d), ["ev"], 0.5))


@query("agg_top_share", UNITS, """SELECT ev, round(q, 6) AS threshold, round(sum(CASE WHEN r >= q THEN y END) / nullif(sum(y), 0)::DOUBLE, 6) AS caught, round(avg(CASE WHEN r >= q THEN y END), 6) AS "precision"
  FROM (SELECT *, quantile_cont(r, 0.9) OVER (PARTITION BY ev) AS q FROM units) GROUP BY ev, q""")
def agg_top_share(spark, d):
    u = units(spark, d)
    cut = quantiles.exact(u, ["ev"], "r", {"q": 0.9})
    hit = F.when(F.col("r") >= F.col("q"), F.col("y"))
    return rounded(u.join(cut, "ev").groupBy("ev", "q").agg(F.try_divide(F.sum(hit).cast("double"), F.sum("y").cast("double")).alias("caught"), F.avg(hit).alias("precision")).withColumnRenamed("q", "threshold"))


@query("agg_ratio", UNITS, "SELECT ev, round(sum(errors) / nullif(sum(n_ref), 0)::DOUBLE, 6) AS wer FROM units GROUP BY ev")
def agg_ratio(spark, d):
    return rounded(units(spark, d).groupBy("ev").agg(metrics.ratio(F.col("errors"), F.col("n_ref")).alias("wer")))


_BUDGET = UNITS + f""", b(budget) AS (VALUES {", ".join(f"({b}::DOUBLE)" for b in BUDGETS)}),
thr AS (SELECT ev, budget, min(r) AS threshold FROM (
  SELECT ev, r, row_number() OVER (PARTITION BY ev ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY ev) AS n FROM units WHERE tuning), b
  WHERE k >= ceil((n - 1)::DOUBLE * (1.0::DOUBLE - budget)) GROUP BY ev, budget),
dec AS (SELECT u.*, budget, r >= threshold AS review FROM units u JOIN thr USING (ev) WHERE NOT tuning)"""
_POINTS = """SELECT ev, budget, round(avg(CAST(review AS INT)), 6) AS review_rate, round(sum(CASE WHEN review THEN y END) / nullif(sum(y), 0)::DOUBLE, 6) AS err_caught,
  round(avg(CASE WHEN NOT review THEN y END), 6) AS accepted_err_rate, round(sum(CASE WHEN NOT review THEN errors END) / nullif(sum(CASE WHEN NOT review THEN n_ref END), 0)::DOUBLE, 6) AS accepted_wer,
  round(sum(CASE WHEN review THEN errors END) / nullif(sum(errors), 0)::DOUBLE, 6) AS word_errors_caught, CAST(coalesce(sum(CASE WHEN NOT review THEN y END), 0) AS BIGINT) AS n_accepted_errors,
  round(avg(CASE WHEN NOT review THEN r END), 6) AS pred_accepted_err, round(avg(CASE WHEN NOT review THEN crit END), 6) AS accepted_crit_err_rate,
  round(sum(CASE WHEN review THEN crit END) / nullif(sum(crit), 0)::DOUBLE, 6) AS crit_caught FROM dec GROUP BY ev, budget"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    cut = thresholds.budget(u.filter("tuning"), ["ev"], BUDGETS)
    return u.filter("NOT tuning").join(F.broadcast(cut), "ev").withColumn("review", thresholds.decide(F.col("r"), F.col("threshold"), True))


@query("thr_budget", _BUDGET, "SELECT ev, budget, round(threshold, 6) AS threshold FROM thr")
def thr_budget(spark, d):
    return rounded(thresholds.budget(units(spark, d).filter("tuning"), ["ev"], BUDGETS))


@query("prj_decide", _BUDGET, "SELECT unit_id, budget, review FROM dec")
def prj_decide(spark, d):
    return _decided(spark, d).select("unit_id", "budget", "review")


@query("agg_operating_point", _BUDGET, _POINTS)
def agg_operating_point(spark, d):
    return rounded(metrics.operating_points(_decided(spark, d), ["ev", "budget"]))


@query("agg_headline", _BUDGET, f"SELECT ev, budget, review_rate, err_caught, accepted_err_rate, accepted_wer FROM ({_POINTS})")
def agg_headline(spark, d):
    return rounded(metrics.operating_points(_decided(spark, d), ["ev", "budget"]).select("ev", "budget", "review_rate", "err_caught", "accepted_err_rate", "accepted_wer"))


_CUTS = UNITS + """, cuts AS (SELECT ev, r, sum(k) OVER w AS n, sum(bad) OVER w AS wrong, sum(pr) OVER w AS psum FROM (
  SELECT ev, r, count(*) AS k, sum(y) AS bad, sum(r) AS pr FROM units GROUP BY ev, r) WINDOW w AS (PARTITION BY ev ORDER BY r)),
a(alpha) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE))"""
_INF = "coalesce(max(CASE WHEN {ok} THEN round(r, 6) END), '-inf'::DOUBLE)"


@query("thr_risk_target", _CUTS, f"SELECT ev, alpha, {_INF.format(ok='n >= 30 AND wrong / n::DOUBLE <= alpha + 1e-12')} AS threshold FROM cuts, a GROUP BY ev, alpha")
def thr_risk_target(spark, d):
    return thresholds.risk_target(units(spark, d), ["ev"], ALPHAS).withColumn("threshold", F.when(F.col("threshold") == F.lit(-math.inf), F.col("threshold")).otherwise(F.round("threshold", 6)))


@query("thr_plugin", _CUTS, f"SELECT ev, alpha, {_INF.format(ok='psum / n::DOUBLE <= alpha + 1e-12')} AS threshold FROM cuts, a GROUP BY ev, alpha")
def thr_plugin(spark, d):
    return thresholds.plugin(units(spark, d), ["ev"], ALPHAS).withColumn("threshold", F.when(F.col("threshold") == F.lit(-math.inf), F.col("threshold")).otherwise(F.round("threshold", 6)))


@query("thr_risk_cp")
def thr_risk_cp(spark, d):
    return thresholds.risk_clopper_pearson(units(spark, d), ["ev"], ALPHAS)


@query("st_miss_gap", _BUDGET, """SELECT ev, budget, round(sum(CASE WHEN NOT review THEN y END) / greatest(sum(y), 1)::DOUBLE, 6) AS miss, round(abs(avg(CASE WHEN NOT review THEN y END) - 0.1), 6) AS gap FROM dec GROUP BY ev, budget""")
def st_miss_gap(spark, d):
    acc = F.when(~F.col("review"), F.col("y"))
    return rounded(_decided(spark, d).groupBy("ev", "budget").agg((F.sum(acc) / F.greatest(F.sum("y"), F.lit(1))).alias("miss"), F.abs(F.avg(acc) - 0.1).alias("gap")))


@query("agg_deployment", _BUDGET, """SELECT ev, budget, round(avg(e), 6) AS mean_errors, round(avg(c), 6) AS mean_crit, round(avg(CAST(c > 0 AS INT)), 6) AS share_with_crit
  FROM (SELECT ev, budget, group_id, coalesce(sum(CASE WHEN NOT review THEN y END), 0) AS e, coalesce(sum(CASE WHEN NOT review THEN crit END), 0) AS c FROM dec GROUP BY ALL) GROUP BY ev, budget""")
def agg_deployment(spark, d):
    left = lambda c: F.coalesce(F.sum(F.when(~F.col("review"), F.col(c))), F.lit(0))
    totals = _decided(spark, d).groupBy("ev", "budget", "group_id").agg(left("y").alias("e"), left("crit").alias("c"))
    return rounded(totals.groupBy("ev", "budget").agg(F.avg("e").alias("mean_errors"), F.avg("c").alias("mean_crit"), F.avg((F.col("c") > 0).cast("double")).alias("share_with_crit")))


_P4 = "1 / (1 + exp(-(0.8 * ln(least(greatest(r, 1e-6), 1 - 1e-6) / (1 - least(greatest(r, 1e-6), 1 - 1e-6))) + 0.3)))"


_ERRORS = {"e": "sum(errors)", "n": "sum(n_ref)", "y": "sum(y)", "k": "count(*)", "b3": "sum((r - y) * (r - y))", "b4": "sum((p4 - y) * (p4 - y))"}
_COUNTS = {"n": "count(*)", "y": "sum(y)"}
_DRAWS = UNITS + ", tu AS (SELECT *, " + _P4 + " AS p4 FROM units), " + ", ".join(
    drawn_sql(f"r{seed}", "tu", "ev", seed, "", _ERRORS) for seed in (0, 1)
) + """,
reps AS (SELECT ev, rep, e::DOUBLE / nullif(n, 0) AS wer, y::DOUBLE / nullif(k, 0) AS rate, b3 / k AS brier3, b4 / k AS brier4 FROM r0),
reps2 AS (SELECT ev, rep, e::DOUBLE / nullif(n, 0) AS wer FROM r1)"""


def _stats():
    return {"wer": (F.col("errors"), F.col("n_ref")), "rate": (F.col("y"), F.lit(1))}


def _reps(spark: SparkSession, d: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    u = units(spark, d)
    return u, bootstrap.resampled_ratios(u, ["ev"], _stats(), 200, seed)


@query("bs_cluster", _DRAWS, """SELECT ev, p.wer, p.rate, round(quantile_cont(r.wer, 0.025), 6) AS wer_lo, round(quantile_cont(r.wer, 0.975), 6) AS wer_hi, round(quantile_cont(r.rate, 0.025), 6) AS rate_lo, round(quantile_cont(r.rate, 0.975), 6) AS rate_hi
  FROM reps r JOIN (SELECT ev, round(sum(errors) / sum(n_ref)::DOUBLE, 6) AS wer, round(avg(y), 6) AS rate FROM units GROUP BY ev) p USING (ev) GROUP BY ev, p.wer, p.rate""")
def bs_cluster(spark, d):
    u, reps = _reps(spark, d)
    return rounded(bootstrap.interval(u, ["ev"], reps, _stats()))


_DIFF = """SELECT ev, round(quantile_cont(diff, 0.025), 6) AS diff_lo, round(quantile_cont(diff, 0.975), 6) AS diff_hi, round(avg(CAST(diff >= 0 AS INT)), 6) AS share_up, round((count(*) FILTER (diff <= 0) + 1)::DOUBLE / (count(diff) + 1), 6) AS p_value
  FROM ({rows}) GROUP BY ev"""


@query("bs_paired", _DRAWS, _DIFF.format(rows="SELECT ev, round(brier4 - brier3, 12) AS diff FROM reps"))
def bs_paired(spark, d):
    # The recalibrated policy less the raw one, in the same replicates.
    u = units(spark, d).withColumn("p4", policies.platt(F.col("r"), 0.8, 0.3))
    error = lambda p: ((F.col(p) - F.col("y")) * (F.col(p) - F.col("y")), F.lit(1))
    reps = bootstrap.resampled_ratios(u, ["ev"], {"b3": error("r"), "b4": error("p4")}, 200, 0)
    return rounded(bootstrap.paired(reps.select("ev", "rep", F.round(F.col("b4") - F.col("b3"), 12).alias("v")), reps.select("ev", "rep", F.lit(0.0).alias("v")), ["ev"], "v"))


@query("bs_unpaired", _DRAWS, _DIFF.format(rows="SELECT a.ev, a.wer - b.wer AS diff FROM reps a JOIN reps2 b ON a.ev = b.ev AND a.rep = b.rep"))
def bs_unpaired(spark, d):
    return rounded(bootstrap.paired(_reps(spark, d)[1], _reps(spark, d, 1)[1], ["ev"], "wer"))


@query("st_one_sided_p", _DRAWS, "SELECT ev, round((count(*) FILTER (wer <= 0.15) + 1)::DOUBLE / (count(wer) + 1), 6) AS p_value FROM reps GROUP BY ev")
def st_one_sided_p(spark, d):
    return rounded(_reps(spark, d)[1].groupBy("ev").agg(bootstrap.one_sided_p(F.col("wer") <= 0.15).alias("p_value")))


@query("st_holm", UNITS, """SELECT ev, group_id, round(p, 6) AS p, round(max(s) OVER (PARTITION BY ev ORDER BY p, group_id), 6) AS p_holm FROM (
  SELECT ev, group_id, p, least(1.0, (count(*) OVER (PARTITION BY ev) - row_number() OVER (PARTITION BY ev ORDER BY p, group_id) + 1) * p) AS s FROM (SELECT ev, group_id, avg(r) / 20 AS p FROM units GROUP BY ev, group_id))""")
def st_holm(spark, d):
    tests = units(spark, d).groupBy("ev", "group_id").agg((F.avg("r") / 20).alias("p"))
    return rounded(bootstrap.holm(tests, ["ev"], "p", "group_id"))


_ALPHA, _TARGET, _SOURCE = 0.2, "de", "en"


def _by_score_sql(name: str, ev: str, seed: int) -> str:
    rows = f"(SELECT * FROM tu WHERE ev = '{ev}' AND NOT tuning)"
    return drawn_sql(f"{name}0", rows, "", seed, "r", _COUNTS) + f", {name} AS (SELECT rep, r, n, y FROM {name}0 UNION ALL SELECT -1, r, count(*), sum(y) FROM {rows} GROUP BY r)"


def _words_sql(name: str, ev: str, seed: int) -> str:
    rows = f"(SELECT u.group_id, 1 - w.p AS r, 1 - w.correct AS y FROM words w JOIN tu u USING (unit_id) WHERE ev = '{ev}' AND NOT tuning)"
    return drawn_sql(f"{name}0", rows, "", seed, "r", _COUNTS) + f", {name} AS (SELECT rep, r, n, y FROM {name}0 UNION ALL SELECT -1, r, count(*), sum(y) FROM {rows} GROUP BY r)"


def _ece_sql(rows: str, p: str = "r") -> str:
    return f"(SELECT rep, sum(abs(sp - sy)) / sum(n) AS v FROM (SELECT rep, least(floor({p} * 15), 14) AS b, sum({p} * n) AS sp, sum(y) AS sy, sum(n) AS n FROM {rows} GROUP BY ALL) GROUP BY rep)"


def _cut_sql(ev: str, p: str) -> str:
    return f"""(SELECT coalesce(max(CASE WHEN n >= 30 AND wrong / n::DOUBLE <= {_ALPHA} + 1e-12 THEN p END), '-inf'::DOUBLE) FROM (
  SELECT p, sum(k) OVER (ORDER BY p) AS n, sum(bad) OVER (ORDER BY p) AS wrong FROM (SELECT {p} AS p, count(*) AS k, sum(y) AS bad FROM tu WHERE ev = '{ev}' AND tuning GROUP BY 1)))"""


def _gap_sql(p: str, cut: str) -> str:
    return f"(SELECT rep, abs(sum(CASE WHEN {p} <= {cut} THEN y END) / nullif(sum(CASE WHEN {p} <= {cut} THEN n END), 0)::DOUBLE - {_ALPHA}) AS v FROM w4, cuts GROUP BY rep)"


def _plugin_sql(p: str) -> str:
    return f"""(SELECT rep, abs(max_by(cy / cn::DOUBLE, cn) FILTER (cp / cn <= {_ALPHA} + 1e-12) - {_ALPHA}) AS v FROM (
  SELECT rep, sum(n) OVER o AS cn, sum(y) OVER o AS cy, sum({p} * n) OVER o AS cp FROM w4 WINDOW o AS (PARTITION BY rep ORDER BY {p} ROWS UNBOUNDED PRECEDING)) GROUP BY rep)"""


_MISS_SQL = "(SELECT rep, sum(CASE WHEN r < t10 THEN y ELSE 0 END)::DOUBLE / greatest(sum(y), 1) AS v FROM {rows}, cuts GROUP BY rep)"
_HYPOTHESES = (
    UNITS + ", " + WORDS + f", tu AS (SELECT *, {_P4} AS p4 FROM units), " + ", ".join((_by_score_sql("w", _TARGET, 1), _by_score_sql("e", _SOURCE, 2), _words_sql("ww", _TARGET, 3), _words_sql("we", _SOURCE, 4)))
    + f""", w4 AS (SELECT *, {_P4} AS p4 FROM w), cuts AS (SELECT {_cut_sql(_SOURCE, "r")} AS t3, {_cut_sql(_TARGET, "p4")} AS t4,
  (SELECT min(r) FROM (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS n FROM tu WHERE ev = '{_SOURCE}' AND tuning) WHERE k >= ceil((n - 1)::DOUBLE * 0.9)) AS t10),
x AS (
  SELECT 'H1' AS hypothesis, 'less' AS direction, rep, sum(r * n - y) / sum(n) AS v FROM w GROUP BY rep
  UNION ALL SELECT 'H2', 'greater', a.rep, a.v - b.v FROM {_MISS_SQL.format(rows="w")} a JOIN {_MISS_SQL.format(rows="e")} b ON a.rep = b.rep
  UNION ALL SELECT 'H3a', 'less', a.rep, a.v - b.v FROM {_ece_sql("w4", "p4")} a JOIN {_ece_sql("w4")} b ON a.rep = b.rep
  UNION ALL SELECT 'H3b', 'less', a.rep, a.v - b.v FROM {_gap_sql("p4", "t4")} a JOIN {_gap_sql("r", "t3")} b ON a.rep = b.rep
  UNION ALL SELECT 'H3c', 'less', a.rep, a.v - b.v FROM {_plugin_sql("p4")} a JOIN {_plugin_sql("r")} b ON a.rep = b.rep
  UNION ALL SELECT 'H4', 'greater', a.rep, a.v - b.v FROM {_ece_sql("ww")} a JOIN {_ece_sql("we")} b ON a.rep = b.rep),
t AS (
  SELECT hypothesis, max(v) FILTER (rep < 0) AS estimate, quantile_cont(v, 0.025) FILTER (rep >= 0) AS ci_lo, quantile_cont(v, 0.975) FILTER (rep >= 0) AS ci_hi, count(v) FILTER (rep >= 0) AS n_boot,
         (count(*) FILTER (rep >= 0 AND CASE WHEN direction = 'less' THEN v >= 0 ELSE v <= 0 END) + 1)::DOUBLE / (count(v) FILTER (rep >= 0) + 1) AS p0, count(*) FILTER (rep >= 0) AS n
  FROM (SELECT hypothesis, direction, rep, round(v, 12) AS v FROM x) GROUP BY hypothesis, direction),
f AS (SELECT *, n_boot >= 0.95 * n AND estimate IS NOT NULL AS testable, CASE WHEN n_boot >= 0.95 * n AND estimate IS NOT NULL THEN p0 END AS p FROM t)"""
)


@query("st_hypotheses", _HYPOTHESES, """SELECT hypothesis, round(estimate, 6) + 0.0 AS estimate, round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi, n_boot, testable, round(p, 6) AS p, round(h, 6) AS p_holm, h < 0.05 AS supported
  FROM (SELECT *, CASE WHEN testable THEN max(s) OVER (ORDER BY coalesce(p, 1), hypothesis) END AS h
        FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY coalesce(p, 1), hypothesis) + 1) * coalesce(p, 1)) AS s FROM f))""")
def st_hypotheses(spark, d):
    """Six tests of the recalibrated policy and of transfer, on the target's and the source's test units. Every statistic follows from the
    replicates' counts and errors by score."""
    u = units(spark, d).withColumn("p4", policies.platt(F.col("r"), 0.8, 0.3))
    of = lambda ev, tuning: u.filter((F.col("ev") == ev) & (F.col("tuning") == tuning))
    one = lambda df: df.withColumn("all", F.lit(1))
    t10 = thresholds.budget(one(of(_SOURCE, True)), ["all"], [0.1]).first()
    t10 = float(t10["threshold"]) if t10 else None
    risk = lambda df, p: thresholds.risk_target(one(df), ["all"], [_ALPHA], p=p).first()
    t3, t4 = (float(found["threshold"]) if found else -math.inf for found in (risk(of(_SOURCE, True), "r"), risk(of(_TARGET, True), "p4")))
    sums = {"n": F.lit(1), "y": F.col("y")}

    def by_score(rows: DataFrame, seed: int) -> DataFrame:
        whole = rows.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).select(F.lit(-1).alias("rep"), "r", "n", "y")
        return records.written(bootstrap.resampled(rows, [], sums, 200, seed, by=["r"]).select("rep", "r", "n", "y").unionByName(whole))

    w, e = by_score(of(_TARGET, False), 1), by_score(of(_SOURCE, False), 2)
    scored = words(spark, d).select("unit_id", (F.lit(1.0) - F.col("p")).alias("r"), (1 - F.col("correct")).alias("y"))
    ww, we = (by_score(scored.join(of(ev, False).select("unit_id", "group_id"), "unit_id"), seed) for ev, seed in ((_TARGET, 3), (_SOURCE, 4)))
    w4 = w.withColumn("p4", policies.platt(F.col("r"), 0.8, 0.3))

    def ece(rows: DataFrame, p: str = "r") -> DataFrame:
        bins = rows.groupBy("rep", metrics.bin_of(F.col(p), 15).alias("b")).agg(F.abs(F.sum(F.col(p) * F.col("n")) - F.sum("y")).alias("off"), F.sum("n").alias("n"))
        return bins.groupBy("rep").agg((F.sum("off") / F.sum("n")).alias("v"))

    def missed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("rep").agg((F.sum(F.when(F.col("r") < F.lit(t10), F.col("y")).otherwise(0)) / F.greatest(F.sum("y"), F.lit(1))).alias("v"))

    def gap(p: str, cut: float) -> DataFrame:
        accepted = F.col(p) <= F.lit(cut)
        return w4.groupBy("rep").agg(F.abs(F.try_divide(F.sum(F.when(accepted, F.col("y"))), F.sum(F.when(accepted, F.col("n")))) - _ALPHA).alias("v"))

    plugged = lambda p: bootstrap.plugin_error(w4, ["rep"], _ALPHA, p).select("rep", F.abs(F.col("error") - _ALPHA).alias("v"))
    less = lambda a, b: a.join(b.withColumnRenamed("v", "v0"), "rep").select("rep", (F.col("v") - F.col("v0")).alias("v"))
    tests = {
        ("H1", "less"): w.groupBy("rep").agg((F.sum(F.col("r") * F.col("n") - F.col("y")) / F.sum("n")).alias("v")), ("H2", "greater"): less(missed(w), missed(e)), ("H3a", "less"): less(ece(w4, "p4"), ece(w4)),
        ("H3b", "less"): less(gap("p4", t4), gap("r", t3)), ("H3c", "less"): less(plugged("p4"), plugged("r")), ("H4", "greater"): less(ece(ww), ece(we)),
    }
    rows = functools.reduce(DataFrame.unionByName, (df.select(F.lit(h).alias("hypothesis"), F.lit(side).alias("direction"), "rep", F.round("v", 12).alias("v")) for (h, side), df in tests.items()))
    found = bootstrap.tested(rows, ["hypothesis", "direction"], "v", "direction").withColumn("family", F.lit(1))
    held = bootstrap.holm(found, ["family"], "p", "hypothesis").drop("family", "direction")
    return rounded(held.withColumn("supported", F.col("p_holm") < 0.05))


@query("st_ks", UNITS, """SELECT ev, n0, n1, round(max(abs(a / nullif(n0, 0)::DOUBLE - b / nullif(n1, 0)::DOUBLE)), 6) AS ks FROM (
  SELECT ev, sum(1 - y) OVER w AS a, sum(y) OVER w AS b, CAST(sum(1 - y) OVER (PARTITION BY ev) AS BIGINT) AS n0, CAST(sum(y) OVER (PARTITION BY ev) AS BIGINT) AS n1 FROM units WINDOW w AS (PARTITION BY ev ORDER BY r)) GROUP BY ev, n0, n1""")
def st_ks(spark, d):
    return rounded(policies.ks_statistic(units(spark, d), ["ev"], "y"))


@query("st_wilson", UNITS, """SELECT ev, k, n, round((k + z * z / 2) / (n + z * z) - z * sqrt(k * (n - k) / n::DOUBLE + z * z / 4) / (n + z * z), 6) AS lo, round((k + z * z / 2) / (n + z * z) + z * sqrt(k * (n - k) / n::DOUBLE + z * z / 4) / (n + z * z), 6) AS hi
  FROM (SELECT ev, CAST(sum(y) AS BIGINT) AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM units GROUP BY ev)""")
def st_wilson(spark, d):
    lo, hi = policies.wilson(F.col("k"), F.col("n"))
    return rounded(units(spark, d).groupBy("ev").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n")).withColumns({"lo": lo, "hi": hi}))


@query("st_drift_alarm", UNITS, """, s AS (SELECT avg(r) AS m, stddev_pop(r) AS sd, quantile_cont(r, 0.9) AS q FROM units WHERE tuning)
SELECT ev, round(avg(CAST(r >= q AS INT)), 6) AS review_share, round((avg(r) - any_value(m)) / any_value(sd), 6) AS risk_shift, abs((avg(r) - any_value(m)) / any_value(sd)) > 0.1 AS fired FROM units, s WHERE NOT tuning GROUP BY ev""")
def st_drift_alarm(spark, d):
    u = units(spark, d)
    base = u.filter("tuning").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"), F.percentile("r", F.lit(0.9)).alias("q"))
    shift = (F.avg("r") - F.first("m")) / F.first("sd")
    return rounded(u.filter("NOT tuning").crossJoin(F.broadcast(base)).groupBy("ev").agg(F.avg((F.col("r") >= F.col("q")).cast("double")).alias("review_share"), shift.alias("risk_shift"), (F.abs(shift) > 0.1).alias("fired")))


@query("st_length_strata", UNITS, """, b(bin, lo, hi) AS (VALUES ('1-9', 1, 9), ('10-30', 10, 30), ('31-50', 31, 50), ('51+', 51, 1000000000), ('matched', 25, 41))
SELECT ev, bin, count(*) AS n, round(avg(y), 6) AS err_rate, round(sum(errors) / sum(n_ref)::DOUBLE, 6) AS wer FROM units JOIN b ON n_ref BETWEEN lo AND hi GROUP BY ev, bin""")
def st_length_strata(spark, d):
    bins = [("1-9", 1, 9), ("10-30", 10, 30), ("31-50", 31, 50), ("51+", 51, 10**9), ("matched", 25, 41)]
    inside = F.array(*(F.when(F.col("n_ref").between(lo, hi), F.lit(name)) for name, lo, hi in bins))
    rows = units(spark, d).withColumn("bin", F.explode(F.filter(inside, lambda b: b.isNotNull())))
    return rounded(rows.groupBy("ev", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("err_rate"), metrics.ratio(F.col("errors"), F.col("n_ref")).alias("wer")))


@query("st_word_confidence", WORDS, """, b AS (SELECT least(floor((1 - p) * 10), 9) AS bin, count(*) AS n, avg(1 - p) AS mp, avg(1 - correct) AS fy FROM words GROUP BY 1)
SELECT round(sum(n * abs(mp - fy)) / sum(n), 6) AS ece, round(sum(n * mp) / sum(n) - sum(n * fy) / sum(n), 6) AS citl, (SELECT round(avg(CAST(correct = 0 AND p >= 0.2 AS INT)), 6) FROM words) AS wrong_confident FROM b""")
def st_word_confidence(spark, d):
    w = words(spark, d).select((F.lit(1.0) - F.col("p")).alias("r"), (1 - F.col("correct")).alias("y"), "p", F.lit(1).alias("all"))
    e, c = metrics.ece(w, ["all"], 10), metrics.calibration(w, ["all"]).select("all", "citl")
    sure = w.groupBy("all").agg(F.avg(((F.col("y") == 1) & (F.col("p") >= 0.2)).cast("double")).alias("wrong_confident"))
    return rounded(e.join(c, "all").join(sure, "all").drop("all"))


@query("st_devpool", UNITS, """, t AS (SELECT min(r) AS threshold FROM (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS n FROM units WHERE tuning) WHERE k >= ceil((n - 1)::DOUBLE * 0.9))
SELECT ev, round(avg(CAST(r >= threshold AS INT)), 6) AS review_rate, round(avg(CASE WHEN r < threshold THEN y END), 6) AS accepted_err_rate FROM units, t WHERE NOT tuning GROUP BY ev""")
def st_devpool(spark, d):
    u = units(spark, d).withColumn("pool", F.lit(1))
    cut = thresholds.budget(u.filter("tuning"), ["pool"], [0.1])
    hit = F.col("r") >= F.col("threshold")
    return rounded(u.filter("NOT tuning").join(F.broadcast(cut), "pool").groupBy("ev").agg(F.avg(hit.cast("double")).alias("review_rate"), F.avg(F.when(~hit, F.col("y"))).alias("accepted_err_rate")))


@query("st_sensitivity", UNITS, """SELECT drop_rule, ev, count(*) AS n, round(avg(y), 6) AS err_rate FROM (
  SELECT 'none' AS drop_rule, ev, y FROM units UNION ALL SELECT 'long', ev, y FROM units WHERE tuning OR n_ref <= 50 UNION ALL SELECT 'critical', ev, y FROM units WHERE tuning OR crit = 0 UNION ALL SELECT 'wildcard', ev, y FROM units WHERE tuning OR errors % 7 <= 4) GROUP BY ALL""")
def st_sensitivity(spark, d):
    rules = F.array(F.lit("none"), F.when(F.col("tuning") | (F.col("n_ref") <= 50), F.lit("long")), F.when(F.col("tuning") | (F.col("crit") == 0), F.lit("critical")), F.when(F.col("tuning") | (F.col("errors") % 7 <= 4), F.lit("wildcard")))
    kept = units(spark, d).withColumn("drop_rule", F.explode(F.filter(rules, lambda x: x.isNotNull())))
    return rounded(kept.groupBy("drop_rule", "ev").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("err_rate")))


@query("st_null_baseline", WORDS, """, n AS (SELECT draw, unit_id, avg(CAST((unit_id * 7 + pos * 13 + draw * 29) % 100 / 100.0::DOUBLE < 1 - p AS INT)) AS wer FROM words, range(20) AS t(draw) GROUP BY draw, unit_id)
SELECT draw, round(avg(CAST(wer > 0.5 AS INT)), 6) AS err_rate, round(avg(wer), 6) AS mean_wer FROM n GROUP BY draw""")
def st_null_baseline(spark, d):
    w = words(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    wrong = ((F.col("unit_id") * 7 + F.col("pos") * 13 + F.col("draw") * 29) % 100 / 100.0).cast("double") < F.lit(1.0) - F.col("p")
    each = w.groupBy("draw", "unit_id").agg(F.avg(wrong.cast("double")).alias("wer"))
    return rounded(each.groupBy("draw").agg(F.avg((F.col("wer") > 0.5).cast("double")).alias("err_rate"), F.avg("wer").alias("mean_wer")))


@query("st_null_refits")
def st_null_refits(spark, d):
    return rounded(null_refits(units(spark, d), words(spark, d), ["r", "n_ref"], draws=20))


def null_refits(u: DataFrame, scored_words: DataFrame, features: list[str], *, draws: int, seed: int = 0, least: float = 0.5, c: float = 1.0) -> DataFrame:
    """What transfer would look like if word confidences were right: a row a draw, with citl and base rate on the target's test units, and ece and misses there less
    those on the source's test units.

    In every draw each word is wrong with probability 1 - p, by a hash of (seed, draw, unit, place); a unit is wrong if more than `least` of its words are, or if it has none. One
    logistic model a draw is fitted on the source's tuning units by these labels, all draws at once; the threshold is that of its 10% budget there.
    """
    wrong = F.pmod(F.xxhash64(F.lit(seed), "draw", "unit_id", "pos"), F.lit(1 << 30)) / F.lit(float(1 << 30)) > F.col("p")
    rows = scored_words.select("unit_id", "pos", "p").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    share = rows.groupBy("draw", "unit_id").agg(F.avg(wrong.cast("double")).alias("share"))
    base = u.filter(F.col("ev").isin(_SOURCE, _TARGET))
    scale = base.filter((F.col("ev") == _SOURCE) & F.col("tuning")).agg(*(f(x).alias(f"{n}_{x}") for x in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = {f"f{i}": (F.col(x) - F.lit(float(scale[f"m_{x}"] or 0.0))) / F.lit(float(scale[f"s_{x}"] or 0.0) or 1.0) for i, x in enumerate(features)}
    drawn = base.withColumns(scaled).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).join(share, ["draw", "unit_id"], "left")
    drawn = records.written(drawn.select("draw", "unit_id", "ev", "tuning", *scaled, (F.coalesce("share", F.lit(1.0)) > least).cast("int").alias("y")))
    model = many.fit(drawn.filter((F.col("ev") == _SOURCE) & F.col("tuning")), ["draw"], list(scaled), "y", l2=1.0 / c)
    model = model.withColumnsRenamed({f: f"w_{f}" for f in scaled})
    score = policies.sigmoid(sum((F.col(f) * F.col(f"w_{f}") for f in scaled), F.col("intercept")))
    scored = records.written(drawn.join(model, "draw").select("draw", "unit_id", "ev", "tuning", "y", score.alias("r")))
    cut = thresholds.budget(scored.filter((F.col("ev") == _SOURCE) & F.col("tuning")), ["draw"], [0.1]).select("draw", "threshold")
    test = scored.filter("NOT tuning").join(cut, "draw")
    by = ["draw", "ev"]
    missed = test.groupBy(*by).agg((F.sum(F.when(F.col("r") < F.col("threshold"), F.col("y")).otherwise(0)) / F.greatest(F.sum("y"), F.lit(1))).alias("miss"), F.avg("y").alias("rate"), (F.avg("r") - F.avg("y")).alias("citl"))
    both = missed.join(metrics.ece(test, by), by).groupBy("draw")
    side = lambda c, ev: F.max(F.when(F.col("ev") == ev, F.col(c)))
    return both.agg(side("citl", _TARGET).alias("citl"), side("rate", _TARGET).alias("base_rate"), (side("ece", _TARGET) - side("ece", _SOURCE)).alias("ece_difference"), (side("miss", _TARGET) - side("miss", _SOURCE)).alias("miss_difference"))


@query("pol_raw", UNITS, "SELECT unit_id, round(1 - r, 6) + 0.0 AS risk FROM units")
def pol_raw(spark, d):
    return rounded(units(spark, d).select("unit_id", policies.raw_risk(F.col("r")).alias("risk")))


_SIG = "n_ref / 60.0::DOUBLE AS nsp, errors / 4.0::DOUBLE AS cr, (errors % 5) / 10.0::DOUBLE AS rep3"


def _signals(spark, d):
    return units(spark, d).withColumns({"nsp": F.col("n_ref") / F.lit(60.0), "cr": F.col("errors") / F.lit(4.0), "rep3": (F.col("errors") % 5) / F.lit(10.0)})


@query("pol_rules", UNITS, f"SELECT unit_id, round(greatest(nsp / 0.6, CASE WHEN cr > 2.4 THEN cr / 2.4 ELSE 0 END, rep3 / 0.2) + 1e-3 * (1 - r), 6) AS risk FROM (SELECT unit_id, r, {_SIG} FROM units)")
def pol_rules(spark, d):
    return rounded(_signals(spark, d).select("unit_id", policies.rules_risk(F.col("nsp"), F.col("cr"), F.col("rep3"), F.col("r")).alias("risk")))


@query("pol_rules_raw", UNITS, f"SELECT unit_id, round(greatest(nsp / 0.6, cr / 2.4), 6) AS risk FROM (SELECT unit_id, {_SIG} FROM units)")
def pol_rules_raw(spark, d):
    return rounded(_signals(spark, d).select("unit_id", policies.rules_risk_raw(F.col("nsp"), F.col("cr")).alias("risk")))


@query("pol_apply", UNITS, "SELECT unit_id, round(1 / (1 + exp(-(-0.4 + 1.1 * (r - 0.5) / 0.3 - 0.2 * (n_ref - 30) / 17))), 6) AS risk FROM units")
def pol_apply(spark, d):
    return rounded(units(spark, d).select("unit_id", policies.linear_score({"r": (0.5, 0.3, 1.1), "n_ref": (30.0, 17.0, -0.2)}, -0.4).alias("risk")))


@query("pol_platt_apply", UNITS, "SELECT unit_id, round(1 / (1 + exp(-(0.8 * ln(q / (1 - q)) + 0.3))), 6) AS risk FROM (SELECT unit_id, least(greatest(r, 1e-6), 1 - 1e-6) AS q FROM units)")
def pol_platt_apply(spark, d):
    return rounded(units(spark, d).select("unit_id", policies.platt(F.col("r"), 0.8, 0.3).alias("risk")))


@query("ml_logreg_cv")
def ml_logreg_cv(spark, d):
    u = units(spark, d)
    model, intercept, c = policies.fit_cross_validated(u, ["r", "n_ref", "duration"], "y", grid=(0.1, 1.0), folds=3)
    return u.select("unit_id", policies.linear_score(model, intercept).alias("p"), F.lit(c).alias("c"))


@query("ml_platt")
def ml_platt(spark, d):
    u = units(spark, d)
    a, b, fell_back = policies.fit_platt(u)
    return u.select("unit_id", policies.platt(F.col("r"), a, b).alias("p"), F.lit(fell_back).alias("fell_back"))


@query("pol_crossfit")
def pol_crossfit(spark, d):
    return policies.cross_fit(units(spark, d), ["r", "n_ref"], "y", folds=3).select("unit_id", "fold", "p")


@query("ml_group_kfold", "RECURSIVE " + UNITS + ", g AS (SELECT group_id AS grp, count(*) AS n FROM units GROUP BY 1)" + DEALT.format(zeros="[0, 0, 0, 0, 0]", times="[1, 1, 1, 1, 1]"), "SELECT CAST(bin - 1 AS INT) AS fold, sum(n)::BIGINT AS n, count(*) AS n_groups FROM one JOIN g ON g.grp IS NOT DISTINCT FROM one.grp WHERE i > 0 GROUP BY bin")
def ml_group_kfold(spark, d):
    return policies.with_folds(units(spark, d)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("n_groups"))


@query("win_cumulative_caught", UNITS, """, c AS (SELECT ev, errors, sum(duration) OVER (PARTITION BY ev ORDER BY r DESC, unit_id ROWS UNBOUNDED PRECEDING) AS spent FROM units), b(budget) AS (VALUES (60.0::DOUBLE), (600.0::DOUBLE), (6000.0::DOUBLE))
SELECT ev, budget, CAST(coalesce(sum(CASE WHEN spent <= budget + 1e-9 THEN errors END), 0) AS BIGINT) AS caught, CAST(sum(errors) AS BIGINT) AS total FROM c, b GROUP BY ev, budget""")
def win_cumulative_caught(spark, d):
    return windows.caught_within(units(spark, d), ["ev"], [60, 600, 6000], F.col("r").desc(), "duration", "errors", "unit_id")


@query("win_queue_topk", UNITS, "SELECT unit_id, round(r, 6) AS r FROM units ORDER BY units.r DESC, unit_id LIMIT 25")
def win_queue_topk(spark, d):
    return rounded(windows.queue(units(spark, d), 25).select("unit_id", "r"))


@query("win_nan_quantiles", UNITS, "SELECT ev, " + ", ".join(f"round(quantile_cont(r, {q}), 6) AS q{i}" for i, q in enumerate((0.025, 0.25, 0.5, 0.75, 0.975))) + " FROM units GROUP BY ev")
def win_nan_quantiles(spark, d):
    return rounded(quantiles.exact(units(spark, d), ["ev"], "r", {f"q{i}": q for i, q in enumerate((0.025, 0.25, 0.5, 0.75, 0.975))}))


@query("agg_asr_summary", UNITS, """SELECT ev, tuning, count(*) AS n, count(DISTINCT group_id) AS n_groups, round(sum(duration) / 3600, 6) AS hours, round(sum(errors) / sum(n_ref)::DOUBLE, 6) AS wer, round(avg(y), 6) AS err_rate, round(avg(crit), 6) AS crit_rate,
  round(quantile_cont(n_ref, 0.5), 6) AS median_length FROM units GROUP BY ev, tuning""")
def agg_asr_summary(spark, d):
    return rounded(
        units(spark, d).groupBy("ev", "tuning").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("n_groups"), (F.sum("duration") / 3600).alias("hours"), metrics.ratio(F.col("errors"), F.col("n_ref")).alias("wer"),
            F.avg("y").alias("err_rate"), F.avg("crit").alias("crit_rate"), F.percentile("n_ref", F.lit(0.5)).alias("median_length"),
        )
    )


@query("agg_overview", UNITS, "SELECT ev, tuning, count(*) AS n, round(sum(errors) / sum(n_ref)::DOUBLE, 3) AS wer, round(avg(y), 3) AS err FROM units GROUP BY ev, tuning")
def agg_overview(spark, d):
    return rounded(units(spark, d).groupBy("ev", "tuning").agg(F.count(F.lit(1)).alias("n"), metrics.ratio(F.col("errors"), F.col("n_ref")).alias("wer"), F.avg("y").alias("err")), 3)


@query("agg_manifest_summary", UNITS, "SELECT ev, group_id, count(*) AS n, count(DISTINCT unit_id) AS n_units, round(sum(duration) / 3600, 6) AS hours FROM units GROUP BY ev, group_id")
def agg_manifest_summary(spark, d):
    return rounded(units(spark, d).groupBy("ev", "group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit_id").alias("n_units"), (F.sum("duration") / 3600).alias("hours")))


@query("agg_feature_shift", UNITS, """, f AS (SELECT ev, tuning, unnest(['r', 'n_ref', 'errors', 'duration']) AS feature, unnest([r, n_ref::DOUBLE, errors::DOUBLE, duration]) AS v FROM units),
s AS (SELECT feature, avg(v) AS m, nullif(stddev_samp(v), 0) AS sd FROM f WHERE tuning GROUP BY feature)
SELECT ev, feature, round(avg(v), 6) AS mean, round((avg(v) - any_value(m)) / any_value(sd), 6) AS shift FROM f JOIN s USING (feature) WHERE NOT tuning GROUP BY ev, feature""")
def agg_feature_shift(spark, d):
    u = units(spark, d).withColumns({c: F.col(c).cast("double") for c in ("n_ref", "errors")})
    f = u.unpivot(["ev", "tuning"], ["r", "n_ref", "errors", "duration"], "feature", "v")
    s = f.filter("tuning").groupBy("feature").agg(F.avg("v").alias("m"), F.nullif(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    return rounded(f.filter("NOT tuning").join(F.broadcast(s), "feature").groupBy("ev", "feature").agg(F.avg("v").alias("mean"), ((F.avg("v") - F.first("m")) / F.first("sd")).alias("shift")))


@query("agg_conf_bins", UNITS, """SELECT ev, CASE WHEN r < 0.5 THEN '0.0-0.5' WHEN r < 0.8 THEN '0.5-0.8' WHEN r < 0.9 THEN '0.8-0.9' ELSE '0.9-1.0' END AS bin, count(*) AS n, round(avg(y), 6) AS err_rate FROM units GROUP BY 1, 2""")
def agg_conf_bins(spark, d):
    b = F.when(F.col("r") < 0.5, "0.0-0.5").when(F.col("r") < 0.8, "0.5-0.8").when(F.col("r") < 0.9, "0.8-0.9").otherwise("0.9-1.0")
    return rounded(units(spark, d).groupBy("ev", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("err_rate")))


@query("agg_histogram", UNITS, "SELECT ev, CAST(least(floor(r * 40), 39) AS INT) AS bin, count(*) AS n, round(count(*) / any_value(t)::DOUBLE * 40, 6) AS density FROM (SELECT *, count(*) OVER (PARTITION BY ev) AS t FROM units) GROUP BY 1, 2")
def agg_histogram(spark, d):
    counted = units(spark, d).groupBy("ev", metrics.bin_of(F.col("r"), 40).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(counted.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("ev")) * 40))


@query("agg_min_count_filter", UNITS, "SELECT ev, group_id, count(*) AS n, round(avg(y), 6) AS err_rate FROM units GROUP BY ev, group_id HAVING count(*) >= 5")
def agg_min_count_filter(spark, d):
    return rounded(units(spark, d).groupBy("ev", "group_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("err_rate")).filter("n >= 5"))


@query("prj_labels_threshold", UNITS, "SELECT unit_id, CAST(w > 0.1 AS INT) AS err, CAST(w > 0 AS INT) AS any_err, CAST(w > 0.3 AS INT) AS severe_err FROM (SELECT unit_id, errors / n_ref::DOUBLE AS w FROM units)")
def prj_labels_threshold(spark, d):
    w = F.col("errors") / F.col("n_ref")
    return units(spark, d).select("unit_id", *((w > t).cast("int").alias(n) for n, t in (("err", 0.1), ("any_err", 0.0), ("severe_err", 0.3))))


@query("prj_ent_label", UNITS, "SELECT unit_id, CASE WHEN errors > 0 THEN CAST(n_ref % 7 < errors AS INT) END AS ent_err FROM units")
def prj_ent_label(spark, d):
    return units(spark, d).select("unit_id", F.when(F.col("errors") > 0, (F.col("n_ref") % 7 < F.col("errors")).cast("int")).alias("ent_err"))


@query("prj_group_id", UNITS, "SELECT unit_id, CASE WHEN unit_id % 5 = 0 THEN 'ses:' || ev ELSE 'spk:' || substr(sha1(group_id), 1, 10) END AS pseudonym FROM units")
def prj_group_id(spark, d):
    return units(spark, d).select("unit_id", F.when(F.col("unit_id") % 5 == 0, F.concat(F.lit("ses:"), "ev")).otherwise(F.concat(F.lit("spk:"), F.substring(F.sha1("group_id"), 1, 10))).alias("pseudonym"))


@query("prj_num_safe", UNITS, "SELECT unit_id, CASE WHEN errors = 0 THEN NULL ELSE round(n_ref / errors::DOUBLE, 6) END AS v FROM units")
def prj_num_safe(spark, d):
    v = F.when(F.col("errors") == 0, F.lit(float("inf"))).otherwise(F.col("n_ref") / F.col("errors"))
    return rounded(units(spark, d).withColumn("x", v).select("unit_id", F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")).alias("v")))


@query("flt_subsets", UNITS, "SELECT subset, count(*) AS n FROM (SELECT unnest(['all', CASE WHEN tuning THEN 'tune' ELSE 'test' END, CASE WHEN crit = 1 THEN 'critical' END, CASE WHEN ev LIKE 'e%' THEN 'e_langs' END]) AS subset FROM units) WHERE subset IS NOT NULL GROUP BY subset")
def flt_subsets(spark, d):
    names = F.array(F.lit("all"), F.when(F.col("tuning"), "tune").otherwise("test"), F.when(F.col("crit") == 1, "critical"), F.when(F.col("ev").startswith("e"), "e_langs"))
    return units(spark, d).select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("subset")).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("flt_queue_mode", _BUDGET, "SELECT 'accepted_errors' AS mode, unit_id, budget FROM dec WHERE NOT review AND y = 1 UNION ALL SELECT 'accepted_critical', unit_id, budget FROM dec WHERE NOT review AND crit = 1 UNION ALL SELECT 'review', unit_id, budget FROM dec WHERE review")
def flt_queue_mode(spark, d):
    modes = F.array(F.when(~F.col("review") & (F.col("y") == 1), "accepted_errors"), F.when(~F.col("review") & (F.col("crit") == 1), "accepted_critical"), F.when(F.col("review"), "review"))
    return _decided(spark, d).select(F.explode(F.filter(modes, lambda m: m.isNotNull())).alias("mode"), "unit_id", "budget")


@query("sv_nearest_budget", _BUDGET, "SELECT ev, arg_min(threshold, (round(abs(budget - 0.12), 9), budget)) AS threshold FROM thr GROUP BY ev")
def sv_nearest_budget(spark, d):
    cut = thresholds.budget(units(spark, d).filter("tuning"), ["ev"], BUDGETS)
    return rounded(cut.groupBy("ev").agg(F.min_by("threshold", F.struct(F.round(F.abs(F.col("budget") - 0.12), 9), "budget")).alias("threshold")))
