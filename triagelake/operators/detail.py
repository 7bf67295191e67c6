"""What a review page shows: points that hold, decisions of all policies for each unit, queues by filter and consultations as documents."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators import scans, thresholds
from triagelake.sources.records import written

Keys = Sequence[str]
#: The pages of a queue: which units they show, and whether the riskiest come first. Mistakes that slipped through are shown most confident first.
PAGES = {"all": ("true", True), "review": ("review", True), "accepted_errors": ("NOT review AND y = 1", False), "accepted_critical": ("NOT review AND crit = 1", False)}


def points(units: DataFrame, risks: Mapping[str, Column], budgets: Sequence[float], alphas: Sequence[float], ev: str = "ev", y: str = "y") -> DataFrame:
    """(ev, policy, point, threshold, inclusive, feasible) for each policy's risk: budgets, and risk targets; a target that no cut meets isn't feasible.

    Units whose risk is null have no part in their policy; a policy without units in a set has no points there.
    """
    long = units.select(ev, F.col(y).alias("__y"), F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), c.cast("double").alias("risk")) for p, c in risks.items()))).alias("x"))
    long = long.select(ev, "__y", "x.*").filter("risk IS NOT NULL")
    name = lambda kind, c: F.format_string(f"{kind}_%.2f", c)
    fixed = thresholds.budget(long, [ev, "policy"], budgets, "risk").select(ev, "policy", name("budget", F.col("budget")).alias("point"), "threshold", F.lit(True).alias("inclusive"))
    target = thresholds.risk_target(long, [ev, "policy"], alphas, p="risk", y="__y").select(ev, "policy", name("risk", F.col("alpha")).alias("point"), "threshold", F.lit(False).alias("inclusive"))
    return fixed.unionByName(target).withColumn("feasible", F.col("threshold") != F.lit(-math.inf))


def with_decisions(units: DataFrame, risks: Mapping[str, Column], found: DataFrame, point: str, ev: str = "ev") -> DataFrame:
    """Adds risks: (policy, risk, threshold, feasible, decision) of each policy at a point, in the order of `risks`; those without a risk or a point are left out.

    The points of a set are one row, so units meet them in a join with as many rows as there are sets.
    """
    of_set = found.filter(F.col("point") == point).groupBy(ev).agg(F.map_from_entries(F.collect_list(F.struct("policy", F.struct("threshold", "inclusive", "feasible")))).alias("__points"))
    given = F.array(*(F.struct(F.lit(p).alias("policy"), c.cast("double").alias("risk")) for p, c in risks.items()))

    def decided(x: Column) -> Column:
        at = F.try_element_at(F.col("__points"), x["policy"])
        review = thresholds.decide(x["risk"], at["threshold"], at["inclusive"])
        return F.struct(x["policy"].alias("policy"), x["risk"].alias("risk"), at["threshold"].alias("threshold"), at["feasible"].alias("feasible"), F.when(review, "review").otherwise("accept").alias("decision"))

    # map_contains_key is null without a map, which filters as false.
    known = F.filter(given, lambda x: x["risk"].isNotNull() & F.map_contains_key(F.coalesce("__points", F.create_map().cast("map<string,struct<threshold:double,inclusive:boolean,feasible:boolean>>")), x["policy"]))
    return units.join(of_set, ev, "left").withColumn("risks", F.transform(known, decided)).drop("__points")


def queue_page(units: DataFrame, page: str, limit: int, risk: str = "r", tie: str = "unit_id") -> DataFrame:
    """The first `limit` units of a page, with place from 1 and total, the number of units that the page has. `units` have review, y and crit."""
    wanted, riskiest = PAGES[page]
    shown = units.filter(wanted).withColumn("page", F.lit(page))
    order = [F.col(risk).desc() if riskiest else F.col(risk).asc(), F.col(tie)]
    # The limit comes before the places are counted: a page is small.
    first = scans.running(shown.orderBy(*order).limit(limit), [], order, {"place": F.lit(1)})
    return first.join(shown.groupBy("page").agg(F.count(F.lit(1)).alias("total")), "page")


def consultations(turns: DataFrame, key: str = "consultation") -> DataFrame:
    """(key, payload): a consultation as a JSON document: n_turns, seconds covered, roles in the order of their first turn, and its turns in order with milliseconds and words."""
    whole = lambda c: F.round(c * 1000).cast("long")
    turn = F.struct("idx", "role", whole(F.col("start")).alias("start_ms"), whole(F.col("end")).alias("end_ms"), F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n_words"))
    found = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    roles = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r.isNotNull()))
    until = F.array_max(F.transform("turns", lambda t: t["end_ms"]))
    return found.select(key, F.to_json(F.struct(F.size("turns").alias("n_turns"), until.alias("until_ms"), roles.alias("roles"), "turns")).alias("payload"))


def pooled_by_system(scored: DataFrame, keys: Keys, limit: float = 0.2) -> DataFrame:
    """Rates of each system over its units (n_ref, hits, subs, dels, ins, errors): words pooled, and units each.

    wer and its three parts, the share of words right, units, words, errors, the mean of the units' own rates, the shares of units above `limit` and without an error.
    Units without reference words count in the pooled rates only.
    """
    own = F.try_divide(F.col("errors").cast("double"), F.col("n_ref"))
    rate = lambda c: F.try_divide(F.sum(c).cast("double"), F.sum("n_ref"))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("n_ref").alias("n_ref"), F.sum("errors").alias("errors"), rate("errors").alias("wer"), rate("subs").alias("sub_rate"), rate("dels").alias("del_rate"),
        rate("ins").alias("ins_rate"), rate("hits").alias("hit_rate"), F.avg(own).alias("mean_wer"), F.avg((own > limit).cast("double")).alias("share_over"), F.avg((own == 0).cast("double")).alias("share_exact"),
    )


def relative_change(rates: DataFrame, keys: Keys, system: str, base: str, other: str, value: str) -> DataFrame:
    """(keys, percent): by how many percent a value of system `other` is below that of `base`; null where the base has none or 0."""
    of = lambda s: F.max(F.when(F.col(system) == s, F.col(value)))
    return rates.groupBy(*keys).agg(of(base).alias("a"), of(other).alias("b")).select(*keys, F.round(100 * (1 - F.try_divide(F.col("b").cast("double"), F.col("a")))).cast("long").alias("percent"))


def left_by_budget(items: DataFrame, keys: Keys, order: Sequence[Column | str], cost: str, errors: str, budgets: Sequence[float], score: str | None = None) -> DataFrame:
    """(keys, budget, left): errors that stay when items are checked in order for as long as their cost is within a share of all cost. Costs are 0 or more.

    With `score`, the column that `order` begins with, items are summed by it first, and only those of the scores at which a budget ends are put in order.
    """
    keys = list(keys)
    limit = F.col("budget") * F.col("__all") + 1e-9
    shares = F.explode(F.array(*(F.lit(float(b)) for b in budgets)))
    gone = lambda spent, lost: F.sum(F.when(spent > limit, F.col(lost)).otherwise(0))
    if score is None:
        total = items.groupBy(*keys).agg(F.sum(cost).alias("__all"))
        spent = scans.running(items, keys, order, {"__spent": F.col(cost)}).join(total, keys).withColumn("budget", shares)
        return spent.groupBy(*keys, "budget").agg(gone(F.col("__spent"), errors).alias("left"))
    groups = written(items.groupBy(*keys, score).agg(F.sum(cost).alias("__cost"), F.sum(errors).alias("__errors")))
    total = groups.groupBy(*keys).agg(F.sum("__cost").alias("__all"))
    # What is spent before a score and with it: all of its items stay, none, or some.
    spent = scans.running(groups, keys, [order[0]], {"__upto": F.col("__cost")}).join(total, keys).withColumn("budget", shares)
    spent = written(spent.withColumn("__before", F.col("__upto") - F.coalesce("__cost", F.lit(0))))
    whole = spent.groupBy(*keys, "budget").agg(gone(F.col("__before"), "__errors").alias("left"))
    ends = spent.filter((F.col("__before") <= limit) & (F.col("__upto") > limit)).select(*keys, score, "budget", "__before", "__all")
    same = lambda names: [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names]
    of = lambda df, *more: df.select(*(F.col(c).alias(f"__of_{c}") for c in [*keys, score]), *more)
    mine = items.join(of(ends).distinct(), same([*keys, score]), "left_semi")
    near = scans.running(mine, [*keys, score], list(order[1:]), {"__spent": F.col(cost)})
    some = near.join(of(ends, "budget", "__before", "__all"), same([*keys, score])).groupBy(*keys, "budget").agg(gone(F.col("__before") + F.col("__spent"), errors).alias("left"))
    return whole.unionByName(some).groupBy(*keys, "budget").agg(F.sum("left").alias("left"))


def first_catch_up(whole: DataFrame, own: DataFrame, keys: Keys) -> DataFrame:
    """(keys, first_budget): the first budget above 0 at which checking whole units (left_by_budget) leaves no more errors than the other curve; null if none does."""
    both = whole.join(own.withColumnRenamed("left", "__own"), [*keys, "budget"])
    return both.groupBy(*keys).agg(F.min(F.when((F.col("budget") > 0) & (F.col("left") <= F.col("__own")), F.col("budget"))).alias("first_budget"))
