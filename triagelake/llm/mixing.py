"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight and a schedule: knots (t, w) over training time 0 to 1 that say how its share rises and falls.
Its target is its share of the budget, at most `cap` times its size, the excess going to the others by weight. The
integral of the schedule is the demand for its words up to a time; inverting that integral at the middle of each
document gives the document's position in training. Documents are sorted by position in ranges.

Only DataFrame functions are used. Running sums over a source are taken in two steps, within hash buckets and over
the buckets, so that a source with a third of all rows is spread over 4096 tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import materialise

#: Word characters are all but white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Schedules dealt to the sources in turn: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (0.25, 1.0), (1.0, 0.5)))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_budget(sizes: DataFrame, *, weights: Sequence[float], budget_ratio: float, cap: float) -> DataFrame:
    """Adds rank and target to a table of sources (source, source_size).

    Sources by code point, null last, get the weights in turn. Targets are min(cap * size, level * weight) with the
    level at which they add up to budget_ratio * all sizes: what resharing the excess by weight, over and over, ends
    in. The windows see one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    full = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(float(budget_ratio)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # Taking sources as capped that need not be only lowers the level, so the highest that leaves its own source below the cap is right.
    capped = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return capped.withColumn("target", target).select("source", "source_size", "rank", "target")


def with_segments(sources: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """Adds the integral of each source's schedule: segments (t0, w0, slope, c0) and its whole area."""
    tables = []
    for knots in schedules:
        area, rows = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            rows.append((t0, w0, (w1 - w0) / (t1 - t0), area))
            area += (w0 + w1) / 2 * (t1 - t0)
        segments = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t0", "w0", "slope", "c0"), row, strict=True))) for row in rows))
        tables.append(F.struct(segments.alias("segments"), F.lit(area).alias("area")))
    return sources.withColumn("schedule", F.element_at(F.array(*tables), (F.col("rank") % len(schedules) + 1).cast("int")))


def position(share: Column, schedule: Column) -> Column:
    """The time at which a source has had `share` (0 to 1) of its words: the inverse of its schedule's integral."""
    need = share * schedule["area"]
    segment = F.element_at(F.filter(schedule["segments"], lambda s: s["c0"] <= need), -1)
    rest = F.greatest(need - segment["c0"], F.lit(0.0))
    root = segment["w0"] + F.sqrt(F.greatest(segment["w0"] * segment["w0"] + F.lit(2.0) * segment["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), segment["t0"] + F.coalesce(F.try_divide(F.lit(2.0) * rest, root), F.lit(0.0)))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    budget_ratio: float = 1.5,
    cap: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """One row a document, in order of first position: id, size, source_size, target, taken, copies, positions.

    size counts words; copies is how often the mix takes the document, at the positions (0 to 1) listed, and taken is
    copies * size. Documents of a source queue by the MD5 of their id; the queue repeats until the target is met, a
    document counting when its middle is below the target, so a source misses its target by half a document at most
    and no document is taken more than ceil(cap) times. A null text has size 0; a null source is a source of its own; rows
    with equal ids stand in the queue by size; a source without words has target 0 and takes none. An empty
    table gives an empty one. Other columns are not read.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = materialise(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("key"), digest.alias("queue")).withColumn("bucket", F.substring("queue", 1, 3)),
        "mix-sizes",
    )
    buckets = sized.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = share_budget(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights=weights, budget_ratio=budget_ratio, cap=cap)
    sources = with_segments(sources, schedules).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source", "rank")
    starts = buckets.withColumn("bucket_start", F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket")) - F.col("bucket_size"))
    starts = starts.select("key", "bucket", "bucket_start").join(sources, "key")

    line = Window.partitionBy("key", "bucket").orderBy("queue", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("end", F.sum("size").over(line)).join(starts, ["key", "bucket"])
    middle = F.col("bucket_start") + F.col("end") - F.col("size") + F.col("size") / F.lit(2.0)
    # Rounds r = 0, 1, ... with r * source_size + middle < target.
    rounds = F.greatest(F.ceil(F.try_divide(F.col("target") - middle, F.col("source_size").cast("double"))), F.lit(0))
    queued = queued.withColumn("middle", middle).withColumn("copies", F.coalesce(rounds, F.lit(0)).cast("int"))
    shares = F.transform(F.slice(F.sequence(F.lit(0), F.col("copies")), F.lit(1), F.col("copies")), lambda r: (r * F.col("source_size") + F.col("middle")) / F.col("target"))
    queued = queued.withColumn("positions", F.transform(shares, lambda s: F.round(position(s, F.col("schedule")), 9)))
    out = queued.select(F.col("id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "positions")
    return out.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), id_col)


def training_order(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The documents as training meets them: a row for each copy the mix takes, sorted by position in ranges.

    Rows of `docs` that repeat an id share its copies: each is taken as often as the mix says for any of them, at most.
    """
    taken = mixed.filter("copies > 0").groupBy(F.col(id_col).alias("id")).agg(F.max_by("positions", "copies").alias("positions"))
    # The columns of `docs` go in a struct, so that their names clash with none here.
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")).join(taken, F.col(f"row.{id_col}").eqNullSafe(F.col("id")))
    return rows.select("row", "id", F.explode("positions").alias("position")).orderBy("position", "id").select("row.*")
