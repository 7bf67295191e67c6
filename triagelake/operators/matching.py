"""Lexicon terms in token lists: the longest match first, from left to right, without overlap.

Runs of tokens meet the lexicon in an equality join, so neither side passes through the driver; Spark broadcasts a small lexicon
by its own statistics. What a unit's matches depend on is its chain of overlapping ones only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(units: DataFrame, keys: Sequence[str], tokens: str, lengths: Sequence[int]) -> DataFrame:
    """(keys, start, length, term): every run of a unit's tokens of the given lengths; `start` counts from 0."""
    size = F.size(tokens)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("term"))))
    rows = units.select(*keys, F.explode(F.array(*(F.coalesce(of(n), F.array().cast("array<struct<start:int,length:int,term:string>>")) for n in lengths))).alias("__of_length"))
    return rows.select(*keys, F.explode("__of_length").alias("__r")).select(*keys, "__r.start", "__r.length", "__r.term")


def term_matches(units: DataFrame, keys: Sequence[str], tokens: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(keys, start, length): the longest term at the first token that begins one, then on behind it.

    Terms are tokens with single spaces between; other white space is evened out, repeated, null and empty ones count once or not at all. Units
    with null or no tokens have no matches; `keys` name a unit, null keys included, and rows with the same keys are one unit only if their tokens are the same.
    What the driver sees are the lengths that terms have.
    """
    clean = F.trim(F.regexp_replace(term, r"[\x20\x09-\x0D]+", " "))
    lexicon = terms.select(clean.alias("term")).filter("term <> ''").distinct().withColumn("__n", F.size(F.split("term", " ")))
    lengths = sorted(r["__n"] for r in lexicon.select("__n").distinct().collect())
    if not lengths:
        return units.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("length")).filter("false")
    found = runs(units, keys, tokens, lengths).join(lexicon.select("term"), "term")
    longest = found.groupBy(*keys, "start").agg(F.max("length").alias("length"))
    line = Window.partitionBy(*keys).orderBy("start")
    reach = F.max(F.col("start") + F.col("length")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = longest.withColumn("__first", F.when(F.col("start") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0))
    chains = apart.withColumn("__chain", F.sum("__first").over(line)).groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("__m"))
    none = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<start:int,length:int>>").alias("kept"))
    step = lambda a, m: F.when(m["start"] >= a["until"], F.struct((m["start"] + m["length"]).alias("until"), F.array_append(a["kept"], m).alias("kept"))).otherwise(a)
    return chains.select(*keys, F.explode(F.aggregate("__m", none, step, lambda a: a["kept"])).alias("__k")).select(*keys, "__k.start", "__k.length")
