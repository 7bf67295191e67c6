"""The base tables that the catalogue's queries read, over the driver's fixtures, and the same in DuckDB's SQL.

`units` stands for scored transcripts (y: wrong, crit: critically wrong, r: risk score), `utt` for utterances of
consultations, `iv` for timed intervals at scale, `words` for scored words, `pairs` for reference and hypothesis token lists
and `lex` for a lexicon. Nothing is sampled; every view covers its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of anything but white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return joined.select(
        F.col("doc_id").alias("unit_id"),
        F.col("lang").alias("ev"),
        F.col("source").alias("group_id"),
        (1 - F.col("quality")).cast("int").alias("y"),
        F.col("toxic").cast("int").alias("crit"),
        (F.col("n_chars") * 7919 % 1000 / 1000.0).cast("double").alias("r"),
        (1 + F.col("n_chars") % 60).cast("long").alias("n_ref"),
        (F.col("doc_id") * 37 % 11).cast("long").alias("errors"),
        (F.col("n_chars") / 15.0).cast("double").alias("duration"),
        (F.col("doc_id") % 10 < 3).alias("tuning"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.length("text").cast("long")
    start = F.coalesce(F.sum(chars).over(before), F.lit(0)) / F.lit(15.0) - F.when(F.col("turn") % 3 == 2, 0.5).otherwise(0.0)
    out = turns.withColumn("start", F.greatest(start, F.lit(0.0)))
    return out.select(F.col("conv_id").alias("consultation"), F.col("turn").alias("idx"), "role", "start", (F.col("start") + chars / F.lit(15.0)).alias("end"), "text")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of floor(value) minutes, in seconds since 1970."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", start.alias("start"), (start + F.floor("value") * 60.0).alias("end"))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def words(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Scored words, with more columns of their documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *more, F.posexplode(tokens_of(F.lower("text"))).alias("pos", "token"))
    given = [c for c in docs.columns if c not in ("doc_id", "pos", "token")]
    return docs.select(F.col("doc_id").alias("unit_id"), *given, F.col("pos").cast("long").alias("pos"), "token", ((F.col("doc_id") * 31 + F.col("pos") * 17) % 100 / 100.0).cast("double").alias("p")).withColumn(
        "correct", (F.col("p") >= 0.3).cast("int")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as reference and hypothesis."""
    turns = table(spark, sf_dir, "conversations").withColumn("hyp", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.filter("hyp IS NOT NULL").select("conv_id", "turn", tokens_of(F.lower("text")).alias("ref"), tokens_of(F.lower("hyp")).alias("hyp"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of at least five letters of the benchmark's texts, with their counts."""
    found = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


UNITS = """units AS (
  SELECT d.doc_id AS unit_id, lang AS ev, source AS group_id, CAST(1 - quality AS INT) AS y, CAST(toxic AS INT) AS crit,
         CAST(n_chars * 7919 % 1000 AS DOUBLE) / 1000 AS r, 1 + n_chars % 60 AS n_ref, d.doc_id * 37 % 11 AS errors,
         CAST(n_chars AS DOUBLE) / 15 AS duration, d.doc_id % 10 < 3 AS tuning
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
UTT = """utt AS (
  SELECT conv_id AS consultation, turn AS idx, role, start, start + length(text) / 15.0::DOUBLE AS "end", text
  FROM (SELECT *, greatest(CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 15.0::DOUBLE
                        - CASE WHEN turn % 3 = 2 THEN 0.5::DOUBLE ELSE 0 END, 0) AS start FROM conversations))"""
IV = """iv AS (
  SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS start, epoch_us(ts) / 1e6::DOUBLE + floor(value) * 60 AS "end" FROM events)"""
WORDS = r"""words AS (
  SELECT doc_id AS unit_id, i - 1 AS pos, t[i] AS token, CAST((doc_id * 31 + (i - 1) * 17) % 100 AS DOUBLE) / 100 AS p,
         CAST((doc_id * 31 + (i - 1) * 17) % 100 >= 30 AS INT) AS correct
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS t FROM documents), range(1, len(t) + 1) AS u(i))"""
PAIRS = r"""pairs AS (
  SELECT conv_id, turn, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ref, regexp_extract_all(lower(nxt), '[^\x20\x09-\x0D]+') AS hyp
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)"""
LEX = """lex AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM benchmark) GROUP BY term)"""
