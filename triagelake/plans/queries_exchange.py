"""Queries on what goes out to files and comes back: stored policies, splits, decoder records, CSV columns; and on terms of several words."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import matching, stored
from triagelake.plans.registry import Registry, rounded
from triagelake.plans.views import LEX, UNITS, WORDS, lexicon, table, tokens_of, units, words
from triagelake.sources import records
from triagelake.streaming import live

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add

_STORED = UNITS + """, risks AS (SELECT unit_id, ev, y, 'P1' AS policy, r AS risk FROM units UNION ALL SELECT unit_id, ev, y, 'P3', 1 / (1 + exp(-(-0.4 + 1.1 * (r - 0.5) / 0.3))) FROM units
  UNION ALL SELECT unit_id, ev, y, 'P4', 1 / (1 + exp(-(0.8 * ln(p / (1 - p)) + 0.3))) FROM (SELECT *, 1 / (1 + exp(-(-0.4 + 1.1 * (r - 0.5) / 0.3))) AS p FROM units)),
cut AS (SELECT policy, risk, sum(k) OVER w AS n, sum(bad) OVER w AS wrong, sum(k) OVER (PARTITION BY policy) AS n_all FROM (SELECT policy, risk, count(*) AS k, sum(y) AS bad FROM risks WHERE ev = 'en' GROUP BY ALL) WINDOW w AS (PARTITION BY policy ORDER BY risk)),
pt AS (SELECT policy, 'budget_' || printf('%.2f', b) AS point, min(risk) AS threshold, true AS inclusive FROM cut, (VALUES (0.05::DOUBLE), (0.1), (0.2)) v(b) WHERE n > ceil((n_all - 1)::DOUBLE * (1.0::DOUBLE - b)) GROUP BY ALL
  UNION ALL SELECT policy, 'risk_' || printf('%.2f', a), coalesce(max(CASE WHEN n >= 30 AND wrong / n::DOUBLE <= a + 1e-12 THEN risk END), '-inf'::DOUBLE), false FROM cut, (VALUES (0.2::DOUBLE), (0.3)) v(a) WHERE policy <> 'P1' GROUP BY policy, a)"""


def _stored(spark, d):
    """Three policies, tuned on one set, written and read back."""
    linear = {"features": {"r": (0.5, 0.3, 1.1)}, "intercept": -0.4}
    given = [stored.Policy("P1", "Confidence", False, "en", raw="r"), stored.Policy("P3", "Linear", True, "en", **linear), stored.Policy("P4", "Recalibrated", True, "en", **linear, platt=(0.8, 0.3))]
    path, u = records.scratch_folder(spark), units(spark, d)
    stored.export(spark, [stored.tuned(p, u, (0.05, 0.1, 0.2), (0.2, 0.3)) for p in given], path)
    return stored.load(spark, path)


@query("pol_export", _STORED, "SELECT unit_id, policy, point, round(risk, 6) AS risk, CASE WHEN inclusive THEN risk >= threshold ELSE risk > threshold END AS review FROM risks JOIN pt USING (policy)")
def pol_export(spark, d):
    """Every unit by the stored policies at all of their points; rules that review above a threshold are stored as at or above the next double."""
    return rounded(stored.decided(units(spark, d), _stored(spark, d)).select("unit_id", "policy", "point", "risk", "review"))


@query("pol_struct", _STORED, "SELECT policy, CASE policy WHEN 'P1' THEN 'Confidence' WHEN 'P3' THEN 'Linear' ELSE 'Recalibrated' END AS label, policy <> 'P1' AS probabilistic, 'en' AS tuned_on, point, round(threshold, 6) AS threshold FROM pt WHERE threshold > '-inf'::DOUBLE")
def pol_struct(spark, d):
    """The records of stored policies, a row a point that holds."""
    rows = [(p.name, p.label, p.probabilistic, p.tuned_on, point, float(t)) for p in _stored(spark, d) for point, t in p.thresholds.items()]
    return rounded(spark.createDataFrame(rows, "policy string, label string, probabilistic boolean, tuned_on string, point string, threshold double").filter("threshold > -1e308"))


@query("sink_splits", UNITS, "SELECT unit_id, group_id, round(duration, 3) AS duration, CASE WHEN tuning THEN 'calibration' ELSE 'test' END AS split FROM units")
def sink_splits(spark, d):
    path = records.scratch_folder(spark)
    records.write_splits(units(spark, d).select("unit_id", "group_id", "duration", F.when(F.col("tuning"), "calibration").otherwise("test").alias("split")), path)
    return spark.read.csv(path, header=True, schema="unit_id long, group_id string, duration double, split string")


@query("src_csv_usecols", "", "SELECT c_custkey, round(c_acctbal::DOUBLE, 2) AS c_acctbal, c_mktsegment FROM customer")
def src_csv_usecols(spark, d):
    path, customers = records.scratch_folder(spark), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    customers.write.csv(path, header=True)
    return rounded(records.read_csv_columns(spark, path, "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string", ["c_custkey", "c_acctbal", "c_mktsegment"]), 2)


@query("sv_decoder_words", WORDS, "SELECT CAST(unit_id AS VARCHAR) AS unit_id, count(*) AS n_words, string_agg(token, ' ' ORDER BY pos) AS text, round(sum(p), 4) AS total_p FROM words WHERE unit_id % 3 > 0 OR correct = 1 GROUP BY unit_id")
def sv_decoder_words(spark, d):
    """Decoder records of all units, then records of every third unit again, without its wrong words: the later ones count."""
    path, w = records.scratch_folder(spark), words(spark, d)

    def write(rows, name, kept=F.lit(True)):
        word = F.struct((F.col("pos") * 0.5).alias("start"), (F.col("pos") * 0.5 + 0.4).alias("end"), F.col("token").alias("word"), F.col("p").alias("probability"))
        found = rows.groupBy(F.col("unit_id").cast("string").alias("unit_id")).agg(F.array_sort(F.collect_list(F.when(kept, word))).alias("words"))
        found.write.json(f"{path}/{name}")

    write(w, "run=1")
    # A unit whose words are all wrong has a later record too, without words.
    write(w.filter("unit_id % 3 = 0"), "run=2", F.col("correct") == 1)
    found = live.latest_words(spark, [f"{path}/run=1", f"{path}/run=2"]).filter(F.size("words") > 0)
    total = F.aggregate("words", F.lit(0.0), lambda a, x: a + x["probability"])
    return rounded(found.select("unit_id", F.size("words").cast("long").alias("n_words"), F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"), total.alias("total_p")), 4)


_TERMS = LEX + r""", b AS (SELECT regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS t FROM benchmark),
terms AS MATERIALIZED (SELECT term FROM lex UNION SELECT array_to_string(t[i:i + n - 1], ' ') FROM b, range(1, len(t) + 1) u(i), (VALUES (2), (3)) v(n) WHERE i + n - 1 <= len(t)),
docs AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS t FROM documents),
grams AS (SELECT unit_id, n AS length, unnest(range(0, len(t) - n + 1)) AS start, unnest([array_to_string(t[k + 1:k + n], ' ') FOR k IN range(0, len(t) - n + 1)]) AS term FROM docs, (VALUES (1), (2), (3)) v(n) WHERE len(t) >= n),
best AS MATERIALIZED (SELECT unit_id, start, max(length) AS length FROM grams SEMI JOIN terms USING (term) GROUP BY ALL),
nxt AS MATERIALIZED (SELECT a.unit_id, a.start, a.length, b.start AS next_start FROM best a ASOF LEFT JOIN best b ON a.unit_id = b.unit_id AND a.start + a.length <= b.start),
walk AS (SELECT * FROM nxt WHERE (unit_id, start) IN (SELECT (unit_id, min(start)) FROM best GROUP BY unit_id) UNION ALL SELECT nxt.* FROM walk JOIN nxt ON nxt.unit_id = walk.unit_id AND nxt.start = walk.next_start)"""


@query("tx_term_find", "RECURSIVE " + _TERMS, "SELECT unit_id, CAST(start AS INT) AS start, CAST(length AS INT) AS length FROM walk")
def tx_term_find(spark, d):
    """Terms of one to three words: the words of the lexicon, and what stands side by side in the benchmark."""
    b = table(spark, d, "benchmark").select("item_id", tokens_of(F.lower("text")).alias("t"))
    terms = lexicon(spark, d).select("term").unionByName(matching.runs(b, [], "t", (2, 3)).select("term"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), tokens_of(F.lower("text")).alias("t"))
    return matching.term_matches(t, ["unit_id"], "t", terms)
