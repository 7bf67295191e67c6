"""Interval algebra: blocks, windows, turns, unions, spread times, clips and merged spots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators import scans
from triagelake.sources.records import written

Keys = Sequence[str]


def blocks(df: DataFrame, keys: Keys, order: Keys = ("start", "end")) -> DataFrame:
    """Adds block (0, 1, ...): a row opens one when it starts at or after the end of all rows before it."""
    line = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("__new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    return opened.withColumn("block", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def block_table(df: DataFrame, keys: Keys, order: Keys = ("start", "end")) -> DataFrame:
    """One row a block: start, end, n, speech, and overlap = speech less the length of the block."""
    grouped = blocks(df, keys, order).groupBy(*keys, "block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("speech"))
    return grouped.withColumn("overlap", F.greatest(F.lit(0.0), F.col("speech") - (F.col("end") - F.col("start"))))


def windows(block_rows: DataFrame, keys: Keys, max_seconds: float = 30.0) -> DataFrame:
    """Packs consecutive blocks (start, end) into windows while a window spans at most max_seconds; a longer block stands alone.

    The state is the window that is open, so this is a fold over the sorted blocks of each key.
    """
    packed = block_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("b"))
    empty = F.array().cast("array<struct<start:double,end:double,n:int>>")

    def add(done: Column, block: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (block["end"] - F.try_element_at(done, F.lit(-1))["start"] <= max_seconds)
        grown = F.struct(last["start"].alias("start"), block["end"].alias("end"), (last["n"] + 1).alias("n"))
        fresh = F.struct(block["start"].alias("start"), block["end"].alias("end"), F.lit(1).alias("n"))
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    folded = packed.select(*keys, F.posexplode(F.aggregate("b", empty, add)).alias("window", "w"))
    return folded.select(*keys, "window", "w.start", "w.end", F.col("w.n").alias("n_blocks"))


def union_length(df: DataFrame, keys: Keys) -> DataFrame:
    """Total length that the intervals of a key cover."""
    return block_table(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def padded(df: DataFrame, keys: Keys, total: Column, pad: float = 0.5, cap: float = 30.0, order: Keys = ("start", "end")) -> DataFrame:
    """Adds lo, hi: each interval padded by at most `pad`, half the gap to its neighbours, and half the room under `cap`."""
    line = Window.partitionBy(*keys).orderBy(*order)
    room = F.greatest(F.lit(0.0), (F.lit(cap) - (F.col("end") - F.col("start"))) / 2)
    left = F.greatest(F.lit(0.0), (F.col("start") - F.coalesce(F.lag("end").over(line), F.lit(0.0))) / 2)
    right = F.greatest(F.lit(0.0), (F.coalesce(F.lead("start").over(line), total) - F.col("end")) / 2)
    return df.withColumn("lo", F.greatest(F.lit(0.0), F.col("start") - F.least(F.lit(pad), left, room))).withColumn("hi", F.least(total, F.col("end") + F.least(F.lit(pad), right, room)))


def turns(df: DataFrame, keys: Keys, pad: float = 0.2, least: float = 0.3) -> DataFrame:
    """Clips of single utterances with text, padded within [0, total], those under `least` seconds dropped."""
    total = F.max("end").over(Window.partitionBy(*keys))
    out = df.withColumn("total", total).withColumn("clip_start", F.greatest(F.lit(0.0), F.col("start") - pad)).withColumn("clip_end", F.least(F.col("total"), F.col("end") + pad))
    return out.filter((F.trim("text") != "") & (F.col("clip_end") - F.col("clip_start") >= least))


def clip_pad(t0: Column, t1: Column, duration: Column, pad: float = 0.3) -> tuple[Column, Column]:
    """The bounds of a review clip: padded, within the unit, one millisecond at least."""
    lo = F.greatest(t0 - pad, F.lit(0.0))
    return lo, F.greatest(F.least(t1 + pad, duration), lo + 0.001)


def spread_even(pos: Column, n: Column, duration: Column) -> Column:
    """Start of word `pos` of n spread evenly over a duration."""
    return pos * duration / n


def spread_chars(df: DataFrame, keys: Keys, token: str = "token", pos: str = "pos", duration: str = "duration", margin: float = 0.1) -> DataFrame:
    """Adds t0, t1 in proportion to characters (each token one more), within margins; the span is 0.2 s at least."""
    line, size = Window.partitionBy(*keys).orderBy(pos), F.length(token) + 1
    span = F.greatest(F.lit(0.2), F.col(duration) - 2 * margin)
    upto, whole = F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.sum(size).over(Window.partitionBy(*keys))
    return df.withColumn("t0", margin + span * (upto - size) / whole).withColumn("t1", margin + span * upto / whole)


def merge_flags(df: DataFrame, keys: Keys, flag: Column, pos: str = "pos", score: str = "p") -> DataFrame:
    """Spots of adjacent flagged words: first, last, n, top_score."""
    line = Window.partitionBy(*keys).orderBy(pos)
    island = F.col(pos) - F.row_number().over(line)
    return df.filter(flag).withColumn("island", island).groupBy(*keys, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"), F.max(score).alias("top_score")).drop("island")


def coverage_bits(df: DataFrame, keys: Keys, lo: Column, hi: Column, bit: Column) -> DataFrame:
    """(keys, bin, bits): which speakers (a bit each) cover each bin from lo to hi."""
    return df.withColumn("bin", F.explode(F.sequence(lo, hi))).groupBy(*keys, "bin").agg(F.bit_or(bit).alias("bits"))


def cover_add(intervals: DataFrame, keys: Keys, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the union of each key's intervals, as disjoint ones; touching intervals are one, null and empty ones none.

    An interval opens a new one if none before it reaches as far as its start: a running maximum over ranges, so that a key with very many intervals is split.
    """
    rows = intervals.filter(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    seen = written(scans.running(rows, keys, ["start", "end"], {}, maxima={"__far": F.col("end")}))
    opened = F.when(F.col("__far").isNull() | (F.col("start") > F.col("__far")), 1).otherwise(0)
    islands = scans.running(seen.withColumn("__new", opened).drop("__far"), keys, ["start", "end", F.col("__new").desc()], {"__island": F.col("__new")})
    return islands.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def cover_marginal(candidates: DataFrame, cover: DataFrame, keys: Keys, id_col: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, id, new_seconds): how much of each candidate a cover (disjoint intervals, see cover_add) doesn't hold. Candidates must not be null or end before they start.

    What is covered before a point is the length of the intervals that start before it, less what the last of them has after it: running sums of intervals and
    points in one order.
    """
    side = lambda at, sign: candidates.select(*keys, F.col(id_col).alias("__id"), F.col(at).alias("t"), F.lit(sign).alias("sign"), F.lit(0.0).alias("length"), F.lit(None).cast("double").alias("far"))
    held = cover.select(*keys, F.lit(None).cast(candidates.schema[id_col].dataType).alias("__id"), F.col("start").alias("t"), F.lit(0).alias("sign"), (F.col("end") - F.col("start")).alias("length"), F.col("end").alias("far"))
    points = side(start, -1).unionByName(side(end, 1)).unionByName(held)
    run = scans.running(points, keys, ["t", "sign", "__id"], {"__sum": F.col("length")}, maxima={"__far": F.col("far")})
    covered = F.col("__sum") - F.greatest(F.coalesce("__far", F.col("t")) - F.col("t"), F.lit(0.0))
    part = run.filter("sign <> 0").groupBy(*keys, F.col("__id").alias(id_col)).agg(F.sum(F.col("sign") * covered).alias("covered"), F.sum(F.col("sign") * F.col("t")).alias("length"))
    return part.select(*keys, id_col, F.greatest(F.col("length") - F.col("covered"), F.lit(0.0)).alias("new_seconds"))
