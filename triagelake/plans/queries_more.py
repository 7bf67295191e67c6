"""Queries on labels, tracks, systems, models and what a review page asks for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions import align, combine, text
from triagelake.operators import many, metrics, policies, quantiles, scans, speech, thresholds
from triagelake.plans.registry import Registry, rounded
from triagelake.plans.views import LEX, UNITS, UTT, WORDS, lexicon, pairs, table, tokens_of, units, utterances, words
from triagelake.sources import records
from triagelake.streaming import live

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add


_folder = records.scratch_folder


@query("sink_parquet", WORDS, "SELECT unit_id, pos, round(CAST(CAST(p AS FLOAT) AS DOUBLE), 5) AS p, correct FROM words")
def sink_parquet(spark, d):
    path = _folder(spark)
    records.write_words(words(spark, d).drop("token"), path)
    return rounded(spark.read.parquet(path).select("unit_id", "pos", F.col("p").cast("double").alias("p"), F.col("correct").cast("int").alias("correct")), 5)


@query("sink_csv_fmt", UNITS, "SELECT ev, CAST(count(*) AS INT) AS n, round(avg(r), 4) AS mean_r FROM units GROUP BY ev")
def sink_csv_fmt(spark, d):
    path = _folder(spark)
    records.write_csv(rounded(units(spark, d).groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r")), 4), path)
    return spark.read.csv(path, header=True, schema="ev string, n int, mean_r double")


@query("sink_export_private", UNITS, "SELECT unit_id, ev, y FROM units")
def sink_export_private(spark, d):
    return records.without_private(units(spark, d), ("group_id", "crit", "r", "n_ref", "errors", "duration", "tuning"))


@query("sink_json_metrics", UNITS, """SELECT ev, '{"n":' || count(*) || ',"errors":' || CAST(sum(y) AS BIGINT) || '}' AS result FROM units GROUP BY ev""")
def sink_json_metrics(spark, d):
    return units(spark, d).groupBy("ev").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.sum("y").alias("errors"))).alias("result"))


@query("src_jsonl_records", "", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id")
def src_jsonl_records(spark, d):
    path = _folder(spark)
    # A later record stands in a later file, or further down: tasks write ranges of turns.
    turns = table(spark, d, "conversations").repartitionByRange("turn").sortWithinPartitions("turn")
    turns.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("unit_id"), F.col("turn").cast("double").alias("audio_s"), "text")).alias("value")).write.text(path)
    return records.read_records(spark, path).select(F.col("unit_id").cast("long").alias("conv_id"), F.col("audio_s").cast("long").alias("turn"))


@query("flt_set_label", UNITS, "SELECT CASE WHEN tuning THEN 'train' ELSE ev || '/' || group_id END AS set_label, count(*) AS n FROM units GROUP BY 1")
def flt_set_label(spark, d):
    return units(spark, d).groupBy(F.when(F.col("tuning"), "train").otherwise(F.concat_ws("/", "ev", "group_id")).alias("set_label")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_kind", UNITS, "SELECT unit_id, CAST(CASE ev WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS INT) AS kind FROM units")
def flt_kind(spark, d):
    return units(spark, d).select("unit_id", F.when(F.col("ev") == "en", 0).when(F.col("ev") == "de", 1).otherwise(2).alias("kind"))


_DROPPED = UNITS + ", dr AS (SELECT *, CASE WHEN unit_id % 7 = 0 THEN 'short' WHEN unit_id % 7 = 1 THEN '' END AS reason FROM units)"


@query("flt_not_dropped", _DROPPED, "SELECT unit_id FROM dr WHERE coalesce(reason, '') = ''")
def flt_not_dropped(spark, d):
    u = units(spark, d).withColumn("reason", F.when(F.col("unit_id") % 7 == 0, "short").when(F.col("unit_id") % 7 == 1, ""))
    return u.filter(F.coalesce("reason", F.lit("")) == "").select("unit_id")


@query("flt_infer_scope", UNITS, "SELECT unit_id, ev FROM units WHERE ev IN ('en', 'fr') AND NOT tuning")
def flt_infer_scope(spark, d):
    return units(spark, d).filter(F.col("ev").isin("en", "fr") & ~F.col("tuning")).select("unit_id", "ev")


@query("flt_overlap", UNITS, "SELECT unit_id FROM units WHERE NOT (duration > 60 AND NOT tuning)")
def flt_overlap(spark, d):
    return units(spark, d).filter(~((F.col("duration") > 60) & ~F.col("tuning"))).select("unit_id")


@query("prj_crit_label", UNITS, "SELECT unit_id, CAST(crit + errors % 2 > 0 AS INT) AS crit_err FROM units")
def prj_crit_label(spark, d):
    return units(spark, d).select("unit_id", (F.col("crit") + F.col("errors") % 2 > 0).cast("int").alias("crit_err"))


@query("prj_err_c3", UNITS, "SELECT unit_id, CAST((errors + greatest(errors - 3, 0)) / n_ref::DOUBLE > 0.1 AS INT) AS err_c3 FROM units")
def prj_err_c3(spark, d):
    return units(spark, d).select("unit_id", ((F.col("errors") + F.greatest(F.col("errors") - 3, F.lit(0))) / F.col("n_ref") > 0.1).cast("int").alias("err_c3"))


@query("prj_domain", UTT, "SELECT consultation, idx, regexp_replace('turn_' || role, '^turn_.*', 'turn') AS domain FROM utt")
def prj_domain(spark, d):
    return utterances(spark, d).select("consultation", "idx", F.regexp_replace(F.concat(F.lit("turn_"), "role"), "^turn_.*", "turn").alias("domain"))


@query("ft_role", UTT, "SELECT consultation, idx, CASE WHEN role IN ('user', 'assistant') THEN role END AS speaker FROM utt")
def ft_role(spark, d):
    return utterances(spark, d).select("consultation", "idx", F.when(F.col("role").isin("user", "assistant"), F.col("role")).alias("speaker"))


@query("join_index_loc", UNITS, "SELECT unit_id, row_number() OVER (PARTITION BY ev ORDER BY r DESC, unit_id) AS place FROM units")
def join_index_loc(spark, d):
    u = units(spark, d)
    order = u.select("unit_id", F.row_number().over(Window.partitionBy("ev").orderBy(F.desc("r"), "unit_id")).cast("long").alias("place"))
    return u.select("unit_id").join(order, "unit_id")


@query("join_interval_overlap", UTT, """SELECT a.consultation, a.idx AS a, b.idx AS b, round(least(a."end", b."end") - greatest(a.start, b.start), 6) AS shared FROM utt a JOIN utt b ON a.consultation = b.consultation AND a.idx < b.idx AND a.start < b."end" AND a."end" > b.start""")
def join_interval_overlap(spark, d):
    u = utterances(spark, d).select("consultation", "idx", "start", "end")
    a, b = u.alias("a"), u.alias("b")
    hit = (F.col("a.consultation") == F.col("b.consultation")) & (F.col("a.idx") < F.col("b.idx")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start"))
    return rounded(a.join(b, hit).select("a.consultation", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), (F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("shared")))


_FORM = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (text.CANONICAL | text.TITLES).items()) + " ELSE x END"


@query("tx_units_map", "", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda x: {_FORM}), ' ') AS tokens FROM documents")
def tx_units_map(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.canonical_units(tokens_of(F.lower("text"))), " ").alias("tokens"))


_IN = {name: "(" + ", ".join(f"'{w}'" for w in found) + ")" for name, found in (("neg", text.NEGATIONS), ("count", text.COUNT_WORDS), ("func", text.FUNCTION_WORDS))}


@query("tx_weights", WORDS, rf"""SELECT token, CASE WHEN token IN {_IN['neg']} OR (NOT regexp_matches(token, '^\d+(st|nd|rd|th)$') AND (regexp_matches(token, '\d') OR token IN {_IN['count']})) THEN 10.0::DOUBLE
  WHEN token IN {_IN['func']} THEN 0.2::DOUBLE ELSE 1.0 END AS weight FROM (SELECT DISTINCT token FROM words)""")
def tx_weights(spark, d):
    found = words(spark, d).select("token").distinct()
    return found.select("token", text.weight(text.category(F.col("token"), F.lit(None).cast("string"), F.lit(False))).alias("weight"))


@query("tx_term_candidates", LEX, "SELECT term FROM lex WHERE length(term) >= 3 AND regexp_matches(term, '^[a-z]+$') AND term NOT IN ('there', 'which', 'while', 'about')")
def tx_term_candidates(spark, d):
    return lexicon(spark, d).filter((F.length("term") >= 3) & F.col("term").rlike("^[a-z]+$") & ~F.col("term").isin(text.FUNCTION_WORDS)).select("term")


@query("al_ops")
def al_ops(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.posexplode(combine.diff_rows("ref", "hyp")).alias("pos", "x")).select("conv_id", "turn", "pos", "x.*")


@query("tx_lcs_diff")
def tx_lcs_diff(spark, d):
    ops = align.lcs_diff(("um", "uh", "er", "mm", "hmm", "mhm"))(F.col("ref"), F.col("hyp"))
    return pairs(spark, d).select("conv_id", "turn", F.posexplode(ops).alias("pos", "x")).select("conv_id", "turn", "pos", "x.op", "x.token")


@query("al_rover")
def al_rover(spark, d):
    p = lambda c, k: F.transform(c, lambda t, i: ((i * 17 + k) % 100 / 100.0).cast("double"))
    return pairs(spark, d).select("conv_id", "turn", combine.combine_words("ref", p("ref", 3), "hyp", p("hyp", 41)).alias("words"))


@query("al_critical")
def al_critical(spark, d):
    a = pairs(spark, d).withColumn("a", align.aligned("ref", "hyp")).select("conv_id", "turn", F.posexplode(F.arrays_zip("ref", "a.ref_status")).alias("pos", "x"))
    marked = a.withColumns({"token": F.col("x.ref"), "nxt": F.lead("x.ref").over(Window.partitionBy("conv_id", "turn").orderBy("pos"))})
    crit = text.is_negation(F.col("token")) | text.is_number(F.col("token"), F.col("nxt"))
    return marked.groupBy("conv_id", "turn").agg(F.count(F.when(crit, 1)).alias("n"), F.count(F.when(crit & (F.col("x.ref_status") == "C"), 1)).alias("correct"))


@query("ft_word_gap", WORDS, """SELECT unit_id, g AS gap, round(coalesce(a.p, 1), 6) AS before, round(coalesce(b.p, 1), 6) AS after FROM (SELECT unit_id, unnest(range(0, max(pos) + 2)) AS g FROM words GROUP BY unit_id) s
LEFT JOIN words a USING (unit_id) LEFT JOIN words b USING (unit_id) WHERE false UNION ALL SELECT unit_id, pos AS gap, round(lag(p, 1, 1.0) OVER w, 6), round(p, 6) FROM words WINDOW w AS (PARTITION BY unit_id ORDER BY pos) UNION ALL SELECT unit_id, max(pos) + 1, round(arg_max(p, pos), 6), 1.0 FROM words GROUP BY unit_id""")
def ft_word_gap(spark, d):
    line = Window.partitionBy("unit_id").orderBy("pos")
    w = words(spark, d)
    inner = w.select("unit_id", F.col("pos").alias("gap"), F.lag("p", 1, 1.0).over(line).alias("before"), F.col("p").alias("after"))
    last = w.groupBy("unit_id").agg((F.max("pos") + 1).alias("gap"), F.max_by("p", "pos").alias("before")).withColumn("after", F.lit(1.0))
    return rounded(inner.unionByName(last))


_SAMPLES = "sm AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value / 100 AS x FROM events)"
_DB = _SAMPLES + """, db AS (SELECT user_id, pos // 2 AS hop, 10 * log10(greatest(pw, 1e-10)) AS db FROM (SELECT *, avg(x * x) OVER w AS pw, count(*) OVER w AS n FROM sm WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 AND pos % 2 = 0),
mk AS (SELECT user_id, hop, db, db > f + 6 AS speech FROM db JOIN (SELECT user_id, quantile_cont(db, 0.2) AS f FROM db GROUP BY user_id) USING (user_id))"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("event_id")
    samples = table(spark, d, "events").select("user_id", (F.row_number().over(line) - 1).alias("pos"), (F.col("value") / 100).alias("x"))
    return speech.frame_levels(samples, ["user_id"], 5, 2)


@query("ft_audio_frame_db", _DB, "SELECT user_id, hop, round(db, 5) AS db FROM db")
def ft_audio_frame_db(spark, d):
    return rounded(_levels(spark, d), 5)


@query("ft_speech_mask", _DB, "SELECT user_id, hop, speech FROM mk")
def ft_speech_mask(spark, d):
    return speech.speech_mask(_levels(spark, d), ["user_id"], 6.0).select("user_id", "hop", "speech")


_SHARE = "SELECT user_id, round(avg(CAST(speech AS INT)), 6) AS share FROM mk WHERE hop BETWEEN 2 AND 9 AND user_id IN (SELECT user_id FROM mk WHERE hop = 10) GROUP BY user_id"


@query("ft_track_share", _DB, _SHARE)
def ft_track_share(spark, d):
    mask = speech.speech_mask(_levels(spark, d), ["user_id"], 6.0)
    track = speech.cumulative(mask, ["user_id"])
    spans = mask.select("user_id").distinct()
    return rounded(speech.share_of_span(spans, track, ["user_id"], F.lit(2).cast("long"), F.lit(10).cast("long")).select("user_id", "share"))


# Two channels a user: clicks are the doctor's samples, views the patient's. Words are errors, gaps purchases, in units of four by their number.
_TWO = """, c AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'doctor' ELSE 'patient' END AS role, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos, value / 100 AS x FROM events WHERE event_type IN ('click', 'view')),
l AS (SELECT user_id, role, pos AS hop, 10 * log10(greatest(pw, 1e-10)) AS db FROM (SELECT *, avg(x * x) OVER w AS pw, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY user_id, role ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) WHERE n = 2),
m AS (SELECT l.user_id, l.role, hop, db > f + 3 AS speech FROM l JOIN (SELECT user_id, role, quantile_cont(db, 0.2) AS f FROM l GROUP BY ALL) q ON q.user_id = l.user_id AND q.role = l.role),
z AS (SELECT user_id, min(k) + 1 AS n FROM (SELECT user_id, role, max(hop) AS k FROM m GROUP BY ALL) GROUP BY user_id HAVING count(*) = 2),
h AS (SELECT user_id, n, hop, bool_or(speech AND role = 'doctor') AS doctor, bool_or(speech AND role = 'patient') AS patient FROM m JOIN z USING (user_id) WHERE hop < n GROUP BY ALL)"""
_HOP_S = 0.5


def _track(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).withColumn("role", F.when(F.col("event_type") == "click", "doctor").otherwise("patient"))
    line = Window.partitionBy("user_id", "role").orderBy("event_id")
    samples = e.select("user_id", "role", (F.row_number().over(line) - 1).alias("pos"), (F.col("value") / 100).alias("x"))
    return speech.pack_track(speech.speech_mask(speech.frame_levels(samples, ["user_id", "role"], 2, 1), ["user_id", "role"], 3.0), "user_id")


@query("ft_track_cache", _DB + _TWO, """SELECT e.user_id, b.n, b.block, b.doctor, b.patient FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (
  SELECT z.user_id, z.n, k AS block, CAST(coalesce(sum(CASE WHEN doctor THEN 1::BIGINT << (hop % 32) END), 0) AS BIGINT) AS doctor, CAST(coalesce(sum(CASE WHEN patient THEN 1::BIGINT << (hop % 32) END), 0) AS BIGINT) AS patient
  FROM (SELECT user_id, n, unnest(range(n // 32 + 1)) AS k FROM z) z LEFT JOIN h ON h.user_id = z.user_id AND h.hop // 32 = k GROUP BY ALL) b ON b.user_id = e.user_id""")
def ft_track_cache(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    return users.join(_track(spark, d), "user_id", "left").select("user_id", "n", "block", "doctor", "patient")


_SPAN = "(SELECT i.user_id, i.event_id, z.n, greatest(least(CAST(floor({a} / 0.5) AS BIGINT), z.n), 0) AS ia, greatest(least(CAST(ceil({b} / 0.5) AS BIGINT), z.n), 0) AS ib FROM i LEFT JOIN z ON z.user_id = i.user_id)"
_PART = """(SELECT s.user_id, s.event_id, CASE WHEN s.n IS NOT NULL THEN 1.0::DOUBLE / (greatest(s.ib, s.ia + 1) - s.ia) END AS w, count(*) FILTER (h.doctor) AS doctor, count(*) FILTER (h.patient) AS patient, count(*) FILTER (h.doctor AND h.patient) AS both_, count(*) FILTER (h.doctor OR h.patient) AS any_
  FROM {span} s LEFT JOIN h ON h.user_id = s.user_id AND h.hop >= s.ia AND h.hop < greatest(s.ib, s.ia + 1) GROUP BY s.user_id, s.event_id, s.n, s.ia, s.ib)"""
_ITEMS = """, i AS (SELECT *, first_value(t0) OVER u AS start, last_value(t1) OVER u AS "end", count(*) FILTER (kind = 'word') OVER u AS n_words, CASE unit % 3 WHEN 0 THEN 'doctor' WHEN 1 THEN 'patient' END AS role FROM (
  SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'word' ELSE 'gap' END AS kind, nth // 4 AS unit, nth * 0.3::DOUBLE AS t0, nth * 0.3::DOUBLE + CASE event_type WHEN 'error' THEN 0.25::DOUBLE ELSE 0 END AS t1
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events WHERE event_type IN ('error', 'purchase')))
  WINDOW u AS (PARTITION BY user_id, unit ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_OWN = "CASE role WHEN 'doctor' THEN {p}.doctor WHEN 'patient' THEN {p}.patient ELSE {p}.any_ END"


@query("ft_audio_unit", _DB + _TWO + _ITEMS, f"""SELECT i.user_id, i.event_id, kind, round(p.both_ * p.w, 6) AS ov, round((CASE role WHEN 'doctor' THEN p.patient WHEN 'patient' THEN p.doctor ELSE p.both_ END) * p.w, 6) AS other, round({_OWN.format(p="p")} * p.w, 6) AS own,
  round(q.both_ * q.w, 6) AS u_ov, round({_OWN.format(p="q")} * q.w * greatest("end" - start, 0), 6) AS u_own_s, round(CASE WHEN {_OWN.format(p="q")} * q.w * greatest("end" - start, 0) > 0.05 THEN n_words / ({_OWN.format(p="q")} * q.w * greatest("end" - start, 0)) END, 6) AS u_wps,
  CASE WHEN q.w IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS two_ch
  FROM i JOIN {_PART.format(span=_SPAN.format(a=f"(t0 - CASE kind WHEN 'word' THEN {speech.WORD_PAD} ELSE {speech.GAP_PAD} END)", b=f"(t1 + CASE kind WHEN 'word' THEN {speech.WORD_PAD} ELSE {speech.GAP_PAD} END)"))} p ON p.user_id = i.user_id AND p.event_id = i.event_id
  JOIN {_PART.format(span=_SPAN.format(a="start", b='"end"'))} q ON q.user_id = i.user_id AND q.event_id = i.event_id""")
def ft_audio_unit(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("error", "purchase"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    word = F.col("event_type") == "error"
    i = e.select("user_id", "event_id", F.when(word, "word").otherwise("gap").alias("kind"), nth.alias("nth"), F.when(word, 0.25).otherwise(0.0).alias("long"))
    i = i.select("user_id", "event_id", "kind", F.floor(F.col("nth") / 4).alias("unit"), (F.col("nth") * 0.3).alias("t0"), (F.col("nth") * 0.3 + F.col("long")).alias("t1"))
    unit = Window.partitionBy("user_id", "unit").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    role = F.when(F.col("unit") % 3 == 0, "doctor").when(F.col("unit") % 3 == 1, "patient")
    i = i.withColumns({"start": F.first("t0").over(unit), "end": F.last("t1").over(unit), "n_words": F.count(F.when(F.col("kind") == "word", 1)).over(unit), "role": role})
    found = speech.audio_columns(i, _track(spark, d), "user_id", _HOP_S)
    return rounded(found.select("user_id", "event_id", "kind", "ov", "other", "own", "u_ov", "u_own_s", "u_wps", "two_ch"))


@query("join_time_span_share", _DB + _TWO + _ITEMS, f"""SELECT i.user_id, i.event_id, round(any_ * w, 6) AS share FROM i JOIN {_PART.format(span=_SPAN.format(a="t0", b="t1"))} p ON p.user_id = i.user_id AND p.event_id = i.event_id""")
def join_time_span_share(spark, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, d, "events").filter(F.col("event_type").isin("error", "purchase")).select("user_id", "event_id", "event_type", (nth * 0.3).alias("t0"))
    spans = e.withColumn("t1", F.col("t0") + F.when(F.col("event_type") == "error", 0.25).otherwise(0.0))
    return rounded(speech.span_shares(spans, _track(spark, d), "user_id", F.col("t0"), F.col("t1"), _HOP_S).select("user_id", "event_id", F.col("any").alias("share")))


@query("pol_tuning_set", UNITS, "SELECT p.policy, u.ev, count(*) AS n FROM units u JOIN (VALUES ('source', 'en'), ('target', 'de'), ('target', 'fr'), ('target', 'es')) p(policy, ev) USING (ev) WHERE tuning GROUP BY 1, 2")
def pol_tuning_set(spark, d):
    policy = F.when(F.col("ev") == "en", "source").when(F.col("ev").isin("de", "fr", "es"), "target")
    return units(spark, d).filter("tuning").withColumn("policy", policy).filter("policy IS NOT NULL").groupBy("policy", "ev").agg(F.count(F.lit(1)).alias("n"))


@query("st_feature_support", UNITS, """, q AS (SELECT quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi, avg(r) AS m, stddev_pop(r) AS s FROM units WHERE tuning)
SELECT ev, round(avg(CAST(r < lo OR r > hi AS INT)), 6) AS outside, round(1.1 * (avg(r) - any_value(m)) / any_value(s), 6) AS logit_shift FROM units, q WHERE NOT tuning GROUP BY ev""")
def st_feature_support(spark, d):
    u = units(spark, d)
    q = u.filter("tuning").agg(F.percentile("r", F.lit(0.01)).alias("lo"), F.percentile("r", F.lit(0.99)).alias("hi"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    joined = u.filter("NOT tuning").crossJoin(F.broadcast(q))
    return rounded(joined.groupBy("ev").agg(F.avg(((F.col("r") < F.col("lo")) | (F.col("r") > F.col("hi"))).cast("double")).alias("outside"), (1.1 * (F.avg("r") - F.first("m")) / F.first("s")).alias("logit_shift")))


@query("agg_k_quartiles", UNITS, """, k AS (SELECT k, draw, avg(y) AS v FROM units, (VALUES (2), (5), (10)) a(k), range(10) b(draw) WHERE (unit_id * 7 + draw * 13) % 20 < k GROUP BY k, draw)
SELECT k, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3 FROM k GROUP BY k""")
def agg_k_quartiles(spark, d):
    u = units(spark, d).withColumns({"k": F.explode(F.array(F.lit(2), F.lit(5), F.lit(10)))}).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(9))))
    each = u.filter((F.col("unit_id") * 7 + F.col("draw") * 13) % 20 < F.col("k")).groupBy("k", "draw").agg(F.avg("y").alias("v"))
    return rounded(quantiles.exact(each, ["k"], "v", {f"q{i}": q for i, q in enumerate((0.25, 0.5, 0.75), 1)}))


@query("st_crit_boost", UNITS, "SELECT k, ev, round(sum(CASE WHEN s >= 0.9 THEN crit END) / nullif(sum(crit), 0)::DOUBLE, 6) AS crit_caught FROM (SELECT k, ev, crit, CASE WHEN errors % 3 = 0 THEN r * k ELSE r END AS s FROM units, (VALUES (1), (2), (5), (20)) t(k)) GROUP BY k, ev")
def st_crit_boost(spark, d):
    u = units(spark, d).withColumn("k", F.explode(F.array(*(F.lit(k) for k in (1, 2, 5, 20)))))
    s = F.when(F.col("errors") % 3 == 0, F.col("r") * F.col("k")).otherwise(F.col("r"))
    return rounded(u.groupBy("k", "ev").agg(F.try_divide(F.sum(F.when(s >= 0.9, F.col("crit"))).cast("double"), F.sum("crit").cast("double")).alias("crit_caught")))


@query("agg_flag_stats", WORDS, "SELECT unit_id, count(*) FILTER (p >= 0.85) AS flags, round(count(*) FILTER (p >= 0.85 AND token IN ('no', 'not')) / nullif(count(*) FILTER (p >= 0.85), 0)::DOUBLE, 6) AS share_critical FROM words GROUP BY unit_id")
def agg_flag_stats(spark, d):
    n = lambda c: F.count(F.when(F.expr(c), 1))
    flags, hit = n("p >= 0.85"), n("p >= 0.85 AND token IN ('no', 'not')")
    return rounded(words(spark, d).groupBy("unit_id").agg(flags.alias("flags"), F.try_divide(hit.cast("double"), flags.cast("double")).alias("share_critical")))


@query("agg_weighted_wer", UNITS, "SELECT ev, round(sum(errors * CASE WHEN crit = 1 THEN 10 ELSE 1 END) / sum(n_ref * CASE WHEN crit = 1 THEN 10 ELSE 1 END)::DOUBLE, 6) AS wwer, round(sum(errors) / sum(n_ref)::DOUBLE, 6) AS wer FROM units GROUP BY ev")
def agg_weighted_wer(spark, d):
    w = F.when(F.col("crit") == 1, 10).otherwise(1)
    return rounded(units(spark, d).groupBy("ev").agg(metrics.ratio(F.col("errors") * w, F.col("n_ref") * w).alias("wwer"), metrics.ratio(F.col("errors"), F.col("n_ref")).alias("wer")))


@query("agg_detection", UNITS, """, a AS (SELECT ev, (sum(CASE WHEN crit = 1 THEN rk END) - sum(crit) * (sum(crit) + 1) / 2.0::DOUBLE) / nullif(sum(crit) * (count(*) - sum(crit)), 0)::DOUBLE AS auroc FROM (
  SELECT ev, crit, rank() OVER (PARTITION BY ev ORDER BY r) + (count(*) OVER (PARTITION BY ev, r) - 1) / 2.0::DOUBLE AS rk FROM units) GROUP BY ev),
p AS (SELECT ev, sum(tp / fl::DOUBLE * pos / nullif(al, 0)::DOUBLE) AS auprc FROM (SELECT ev, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS fl, sum(pos) OVER (PARTITION BY ev) AS al
  FROM (SELECT ev, r, count(*) AS n, sum(crit) AS pos FROM units GROUP BY ev, r) WINDOW w AS (PARTITION BY ev ORDER BY r DESC)) GROUP BY ev),
t AS (SELECT ev, sum(CASE WHEN r >= q THEN crit END) / nullif(sum(crit), 0)::DOUBLE AS top_share FROM (SELECT *, quantile_cont(r, 0.9) OVER (PARTITION BY ev) AS q FROM units) GROUP BY ev)
SELECT a.ev, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(top_share, 6) AS top_share FROM a JOIN p ON p.ev = a.ev JOIN t ON t.ev = a.ev""")
def agg_detection(spark, d):
    """How well the score finds critical units: AUROC, average precision, and the share of them in the top tenth."""
    u = units(spark, d)
    top = u.join(quantiles.exact(u, ["ev"], "r", {"q": 0.9}), "ev").groupBy("ev").agg(F.try_divide(F.sum(F.when(F.col("r") >= F.col("q"), F.col("crit"))).cast("double"), F.sum("crit").cast("double")).alias("top_share"))
    return rounded(metrics.auroc(u, ["ev"], y="crit").join(metrics.auprc(u, ["ev"], y="crit").select("ev", "auprc"), "ev").join(top, "ev"))


@query("agg_errors_left", UNITS, """, q AS (SELECT ev, errors, row_number() OVER (PARTITION BY ev ORDER BY r DESC, unit_id) AS k, count(*) OVER (PARTITION BY ev) AS n FROM units), b(budget) AS (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2), (0.5), (1.0))
SELECT ev, budget, CAST(sum(CASE WHEN k > budget * n THEN errors ELSE 0 END) AS BIGINT) AS errors_left, round(sum(CASE WHEN k > budget * n THEN errors ELSE 0 END) / nullif(sum(errors), 0)::DOUBLE, 6) AS share_left FROM q, b GROUP BY ev, budget""")
def agg_errors_left(spark, d):
    """The curve of errors that are left when the riskiest share of units is reviewed."""
    u = units(spark, d).select("ev", "unit_id", "r", "errors")
    ranked = scans.running(u, ["ev"], [F.col("r").desc(), "unit_id"], {"k": F.lit(1)}).join(u.groupBy("ev").agg(F.count(F.lit(1)).alias("n")), "ev")
    each = ranked.withColumn("budget", F.explode(F.array(*(F.lit(b) for b in (0.0, 0.05, 0.1, 0.2, 0.5, 1.0)))))
    left = F.sum(F.when(F.col("k") > F.col("budget") * F.col("n"), F.col("errors")).otherwise(0))
    return rounded(each.groupBy("ev", "budget").agg(left.alias("errors_left"), F.try_divide(left.cast("double"), F.sum("errors").cast("double")).alias("share_left")))


@query("sp_fixed_groups", UNITS, "SELECT unit_id, group_id FROM units WHERE group_id IN ('src0', 'src3', 'src7')")
def sp_fixed_groups(spark, d):
    return units(spark, d).filter(F.col("group_id").isin("src0", "src3", "src7")).select("unit_id", "group_id").orderBy("group_id", "unit_id")


@query("win_top_abs", UNITS, "SELECT group_id, round(s, 6) AS shift, row_number() OVER (ORDER BY round(abs(s), 12) DESC, group_id) AS place FROM (SELECT group_id, avg(r) - 0.5 AS s FROM units GROUP BY group_id)")
def win_top_abs(spark, d):
    s = units(spark, d).groupBy("group_id").agg((F.avg("r") - 0.5).alias("shift"))
    # One row a feature: the window is as small as that.
    return rounded(s.withColumn("place", F.row_number().over(Window.orderBy(F.round(F.abs("shift"), 12).desc(), "group_id")).cast("long")))


@query("sort_consultations", UTT, "SELECT consultation, row_number() OVER (ORDER BY consultation % 3, n DESC, consultation) AS place FROM (SELECT consultation, count(*) AS n FROM utt GROUP BY consultation)")
def sort_consultations(spark, d):
    c = utterances(spark, d).groupBy("consultation").agg(F.count(F.lit(1)).alias("n"), (F.first("consultation") % 3).alias("rank"))
    before = c.groupBy("rank").agg(F.count(F.lit(1)).alias("k"))
    before = before.withColumn("before", F.sum("k").over(Window.orderBy("rank")) - F.col("k"))
    own = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("n"), "consultation"))
    return c.withColumn("own", own).join(F.broadcast(before), "rank").select("consultation", (F.col("before") + F.col("own")).alias("place"))


@query("sv_client_progress", UTT, """SELECT consultation, idx, round(max("end") OVER w, 6) AS decoded_until, "end" < max("end") OVER w AS behind FROM utt WINDOW w AS (PARTITION BY consultation ORDER BY idx)""")
def sv_client_progress(spark, d):
    upto = F.max("end").over(Window.partitionBy("consultation").orderBy("idx"))
    return rounded(utterances(spark, d).select("consultation", "idx", upto.alias("decoded_until"), (F.col("end") < upto).alias("behind")))


def _arrivals(spark, d, copies=1):
    """Turns of conversations as files of a stream, a conversation in one of them; with copies, all arrive again later."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("unit_id"), "role", F.length("text").alias("n_chars"))
    path = records.scratch_folder(spark)
    for _ in range(copies):
        turns.repartition(4, "conv_id").write.mode("append").parquet(path)
    return spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("sv_replayable_log", "", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, turn, conv_id || '-' || turn AS unit_id FROM conversations")
def sv_replayable_log(spark, d):
    log, checkpoint = records.scratch_folder(spark), records.scratch_folder(spark)
    events = live.sequenced(_arrivals(spark, d), "conv_id", ["turn"])
    for _ in range(2):  # the second run finds nothing new
        live.start_log(events, log, checkpoint, available=True).awaitTermination()
    return live.subscribe(spark, log).select("conv_id", "seq", "turn", "unit_id")


@query("sv_cancel_previous", "", "SELECT conv_id, count(*) AS n_turns, true AS cancelled FROM conversations GROUP BY conv_id")
def sv_cancel_previous(spark, d):
    events, name, log = _arrivals(spark, d), f"live-{records.scratch_folder(spark)[-8:]}", records.scratch_folder(spark)
    older = live.start_log(events, records.scratch_folder(spark), records.scratch_folder(spark), name=name)
    newer = live.start_log(events, log, records.scratch_folder(spark), name=name)
    newer.processAllAvailable()
    stopped = not older.isActive and newer.isActive
    newer.stop()
    return live.subscribe(spark, log).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).withColumn("cancelled", F.lit(stopped))


@query("sv_resumable_infer", "", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def sv_resumable_infer(spark, d):
    """Units that come several times, and a job that is started again: each is done once."""
    log, checkpoint = records.scratch_folder(spark), records.scratch_folder(spark)
    units_ = live.once(_arrivals(spark, d, copies=2))
    for _ in range(2):
        live.start_log(units_, log, checkpoint, available=True).awaitTermination()
    return live.subscribe(spark, log).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def learning_curve(u: DataFrame, group: str, ks: tuple[int, ...] = (2, 5, 10, 20), draws: int = 50, seed: int = 0, alpha: float = 0.2) -> DataFrame:
    """A row for each k and draw: k groups recalibrate the score r, by Platt's scaling (P4) and by a shift alone (P4_int), and all others measure it beside the
    score as it is (P3): ece, citl, the accepted error and review rate of the label-free rule at alpha, and of the empirical risk target set on the k groups."""
    keys = ["k", "draw"]
    dealt = records.written(u.join(many.redraws(u, group, ks, draws, seed), group).select(*keys, "inside", "unit_id", "r", "y"))
    inside = dealt.filter("inside")
    fits = records.written(many.platt(inside, keys, "r", "y"))
    z = policies.logit(F.col("r"))
    both = dealt.join(fits, keys).withColumns({"P3": F.col("r"), "P4": policies.sigmoid(F.col("slope") * z + F.col("shift")), "P4_int": policies.sigmoid(z + F.col("only_shift"))})
    held = both.filter("NOT inside").unpivot([*keys, "unit_id", "y"], ["P3", "P4", "P4_int"], "policy", "p")
    held, by = records.written(held), [*keys, "policy"]
    quality = metrics.ece(held, by, p="p").join(metrics.calibration(held, by, p="p").select(*by, "citl"), by)
    plugin = thresholds.plugin(held, by, [alpha], "p").select(*by, F.col("threshold").alias("plugin"))
    risk = thresholds.risk_target(both.filter("inside"), keys, [alpha], p="P4").select(*keys, F.lit("P4").alias("policy"), F.col("threshold").alias("risk"))
    cut = held.join(plugin, by).join(risk, by, "left")
    share = lambda t: (F.avg((F.col("p") > F.col(t)).cast("double")), F.avg(F.when(F.col("p") <= F.col(t), F.col("y"))))
    (pr, pe), (rr, re) = share("plugin"), share("risk")
    points = cut.groupBy(*by).agg(pr.alias("plugin_review"), pe.alias("plugin_accepted_err"), rr.alias("risk_review"), re.alias("risk_accepted_err"))
    return quality.join(points, by).join(fits.select(*keys, F.col("n").alias("n_recal"), "fell_back"), keys)


@query("st_learning_curve")
def st_learning_curve(spark, d):
    u = units(spark, d).withColumn("shelf", F.floor(F.col("unit_id") / 25))
    return rounded(learning_curve(u, "shelf"))


@query("join_entity_nearest")
def join_entity_nearest(spark, d):
    """Two-token entities of the reference, each to its nearest unused place in the hypothesis."""

    @F.pandas_udf("array<int>")
    def nearest(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        wanted = lambda r, h: [(r[i : i + 2], i * len(h) / max(len(r), 1)) for i in range(0, len(r), 2)]
        return pd.Series([combine.nearest_occurrences(list(h), wanted(list(r), h)) for r, h in zip(ref, hyp, strict=True)])

    return pairs(spark, d).select("conv_id", "turn", F.posexplode(nearest("ref", "hyp")).alias("entity", "at"))


def _entity_status(spark: SparkSession, d: str) -> DataFrame:
    a = pairs(spark, d).withColumn("a", align.aligned("ref", "hyp")).select("conv_id", "turn", F.explode(F.arrays_zip("ref", "a.ref_status")).alias("x"))
    kind = F.when(F.length("x.ref") >= 10, "long").when(F.length("x.ref") >= 5, "medium").otherwise("short")
    return a.select("conv_id", "turn", kind.alias("kind"), (F.col("x.ref_status") == "C").cast("int").alias("ok"))


@query("al_entities")
def al_entities(spark, d):
    return _entity_status(spark, d).groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("correct"))


@query("al_terms")
def al_terms(spark, d):
    a = pairs(spark, d).withColumn("a", align.aligned("ref", "hyp")).select("conv_id", F.explode(F.arrays_zip("ref", "a.ref_status")).alias("x")).select("conv_id", F.col("x.ref").alias("term"), F.col("x.ref_status").alias("status"))
    return a.join(lexicon(spark, d).select("term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "C", 1)).alias("correct"))


@query("al_unit_score")
def al_unit_score(spark, d):
    scored = pairs(spark, d).withColumn("a", align.aligned("ref", "hyp"))
    wer = align.counts(F.col("a"))["wer"]
    labels = {n: (wer > t).cast("int") for n, t in (("err", 0.1), ("any_err", 0.0), ("severe_err", 0.3))}
    return rounded(scored.select("conv_id", "turn", *(c.alias(n) for n, c in align.counts(F.col("a")).items()), *(c.alias(n) for n, c in labels.items())))


@query("al_alignment_props")
def al_alignment_props(spark, d):
    a = pairs(spark, d).withColumn("a", align.aligned("ref", "hyp"))
    return a.groupBy("conv_id").agg(*(F.sum(c).alias(n) for n, c in align.counts(F.col("a")).items() if n not in ("wer", "wild_excess")))


@query("tx_audit_sample", UNITS, "SELECT unit_id, ev FROM units ORDER BY md5('7' || unit_id::VARCHAR), unit_id LIMIT 100")
def tx_audit_sample(spark, d):
    # The sample of at most 100 rows is the operator.
    u = units(spark, d).select("unit_id", "ev")
    return u.orderBy(F.md5(F.concat(F.lit("7"), F.col("unit_id").cast("string"))), "unit_id").limit(100).orderBy("unit_id")


@query("sp_sample_n", UNITS, "SELECT unit_id FROM units ORDER BY md5('11' || unit_id::VARCHAR), unit_id LIMIT 50")
def sp_sample_n(spark, d):
    return units(spark, d).select("unit_id").orderBy(F.md5(F.concat(F.lit("11"), F.col("unit_id").cast("string"))), "unit_id").limit(50)


_POLICIES = """SELECT unit_id, 'raw' AS policy, round(1 - r, 6) + 0.0 AS risk FROM units UNION ALL SELECT unit_id, 'rules_raw', round(greatest(n_ref / 60.0::DOUBLE / 0.6, errors / 4.0::DOUBLE / 2.4), 6) FROM units
UNION ALL SELECT unit_id, 'linear', round(1 / (1 + exp(-(-0.4 + 1.1 * (r - 0.5) / 0.3))), 6) FROM units"""


@query("pol_build", UNITS, _POLICIES)
def pol_build(spark, d):
    scores = {"raw": policies.raw_risk(F.col("r")), "rules_raw": policies.rules_risk_raw(F.col("n_ref") / F.lit(60.0), F.col("errors") / F.lit(4.0)), "linear": policies.linear_score({"r": (0.5, 0.3, 1.1)}, -0.4)}
    rows = F.array(*(F.struct(F.lit(n).alias("policy"), c.alias("risk")) for n, c in scores.items()))
    return rounded(units(spark, d).select("unit_id", F.explode(rows).alias("s")).select("unit_id", "s.policy", "s.risk"))


@query("st_eval_label", UNITS, """SELECT a.ev, n, err_rate, brier FROM (SELECT ev, count(*) AS n, round(avg(y), 6) AS err_rate, round(avg((r - y) * (r - y)), 6) AS brier FROM units GROUP BY ev) a""")
def st_eval_label(spark, d):
    u = units(spark, d)
    base = u.groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("err_rate"))
    return rounded(base.join(metrics.calibration(u, ["ev"]).select("ev", "brier"), "ev"))


@query("agg_listening", UNITS, """SELECT ev, budget, round(greatest(0, 1 - budget / 600.0) * avg(e), 6) AS errors_left FROM (SELECT ev, group_id, sum(errors) AS e FROM units GROUP BY ev, group_id), (VALUES (60.0::DOUBLE), (300.0::DOUBLE)) b(budget) GROUP BY ev, budget""")
def agg_listening(spark, d):
    each = units(spark, d).groupBy("ev", "group_id").agg(F.sum("errors").alias("e")).groupBy("ev").agg(F.avg("e").alias("e"))
    left = each.withColumn("budget", F.explode(F.array(F.lit(60.0), F.lit(300.0))))
    return rounded(left.select("ev", "budget", (F.greatest(F.lit(0.0), 1 - F.col("budget") / 600.0) * F.col("e")).alias("errors_left")))


@query("src_utterances", UTT, "SELECT CAST(consultation AS VARCHAR) AS consultation, count(*) AS n FROM utt GROUP BY consultation")
def src_utterances(spark, d):
    # Utterances are written as interval files, one line of text for each interval, and read back from the shared folder.
    item = F.format_string('intervals [%d]:\n xmin = %.3f\n xmax = %.3f\n text = "%s"', F.col("idx") + 1, F.col("start"), F.col("end"), F.replace("text", F.lit('"'), F.lit('""')))
    path = records.scratch_folder(spark)
    utterances(spark, d).select("consultation", item.alias("value")).repartition("consultation").write.partitionBy("consultation").option("lineSep", "\x1e").text(path)
    found = spark.read.option("lineSep", "\x1e").text(path).withColumnRenamed("consultation", "file").filter("value <> ''")
    read = records.parse_intervals(found)
    return read.groupBy(F.col("file").cast("string").alias("consultation")).agg(F.count(F.lit(1)).alias("n"))


@query("src_csv_gz", "", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv_gz(spark, d):
    path = _folder(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True, compression="gzip")
    return records.read_csv_or_parquet(spark, path, "n_nationkey int, n_name string, n_regionkey int", f"{d}/nation.parquet")


@query("sink_markdown", UNITS, r"""SELECT '| ev | n | err_rate | mean_r |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || ev || ' | ' || n || ' | ' || printf('%.1f%%', round(100 * e, 1)) || ' | ' || printf('%.3f', round(m, 3)) || ' |', chr(10) ORDER BY ev) AS report
  FROM (SELECT ev, count(*) AS n, avg(y) AS e, avg(r) AS m FROM units GROUP BY ev)""")
def sink_markdown(spark, d):
    found = units(spark, d).groupBy("ev").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("err_rate"), F.avg("r").alias("mean_r"))
    return records.markdown_report(found, ["ev"], ("err_rate",))


@query("sv_upload_segments")
def sv_upload_segments(spark, d):
    w = words(spark, d).groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") * 0.5).alias("start"), (F.col("pos") * 0.5 + 0.4).alias("end"), F.col("token").alias("word"), F.col("p").alias("probability")))).alias("words"))
    bounds = F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / 20).cast("int")), lambda k: F.struct((k * 10.0).alias("start"), (k * 10.0 + 10.0 - 1e-3).alias("end"), F.lit("").alias("text")))
    return live.words_of_segments(w.withColumn("segments", bounds)).select("unit_id", "segment", F.size("words").alias("n_words"))
