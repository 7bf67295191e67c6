"""Queries on sequences: intervals, positions, text, alignment and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions import align, features, text
from triagelake.operators import intervals, matching, review, windows
from triagelake.plans.registry import Registry, rounded
from triagelake.plans.views import IV, LEX, PAIRS, UTT, WORDS, lexicon, pairs, table, tokens_of, utterances, words
from triagelake.plans.views import intervals as events

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add

_BLOCKS = """, fl AS (SELECT *, CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END AS opens FROM (
  SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)),
bl AS (SELECT user_id, event_id, start, "end", CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS block FROM fl),
bt AS (SELECT user_id, block, min(start) AS start, max("end") AS "end", count(*) AS n, sum("end" - start) AS speech FROM bl GROUP BY user_id, block)"""
_ORDER = ("start", "end", "event_id")


@query("iv_blocks", IV + _BLOCKS, """SELECT user_id, block, round(start, 6) AS start, round("end", 6) AS "end", n FROM bt""")
def iv_blocks(spark, d):
    return rounded(intervals.block_table(events(spark, d), ["user_id"], _ORDER).select("user_id", "block", "start", "end", "n"))


@query("iv_overlap", IV + _BLOCKS, """SELECT user_id, block, round(greatest(0, speech - ("end" - start)), 6) AS overlap FROM bt""")
def iv_overlap(spark, d):
    return rounded(intervals.block_table(events(spark, d), ["user_id"], _ORDER).select("user_id", "block", "overlap"))


@query("iv_union_length", IV + _BLOCKS, """SELECT user_id, round(sum("end" - start), 6) AS covered FROM bt GROUP BY user_id""")
def iv_union_length(spark, d):
    return rounded(intervals.union_length(events(spark, d), ["user_id"]))


_COVER = IV + """, held AS (SELECT * FROM iv WHERE event_type IN ('click', 'view')), hb AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {rows} WHERE start < "end"),
hi AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM hb),
cover AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM hi GROUP BY user_id, island)"""


def _held(spark, d):
    """Intervals that were heard: those of two kinds of events."""
    return events(spark, d).filter(F.col("event_type").isin("click", "view"))


@query("iv_cover_add", _COVER.format(rows="iv"), """SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end" FROM cover""")
def iv_cover_add(spark, d):
    # What was heard, and then everything else, added to its union.
    union = intervals.cover_add(_held(spark, d), ["user_id"])
    rest = events(spark, d).filter(~F.col("event_type").isin("click", "view")).select("user_id", "start", "end")
    return rounded(intervals.cover_add(union.unionByName(rest), ["user_id"]))


@query("iv_cover_marginal", _COVER.format(rows="held"), """SELECT c.user_id, c.event_id, round(c."end" - c.start - coalesce(sum(CASE WHEN h.start IS NOT NULL THEN least(c."end", h."end") - greatest(c.start, h.start) END), 0), 4) + 0.0 AS new_seconds
  FROM iv c LEFT JOIN cover h ON h.user_id = c.user_id AND h.start < c."end" AND h."end" > c.start WHERE c.event_type NOT IN ('click', 'view') GROUP BY c.user_id, c.event_id, c.start, c."end" """)
def iv_cover_marginal(spark, d):
    union = intervals.cover_add(_held(spark, d), ["user_id"])
    rest = events(spark, d).filter(~F.col("event_type").isin("click", "view"))
    return rounded(intervals.cover_marginal(rest, union, ["user_id"], "event_id"), 4)


@query("iv_windows", "RECURSIVE " + UTT + """, fl AS (SELECT *, CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END AS opens FROM (
  SELECT *, max("end") OVER (PARTITION BY consultation ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM utt)),
bt AS (SELECT consultation, block, min(start) AS start, max("end") AS "end" FROM (SELECT consultation, start, "end", sum(opens) OVER (PARTITION BY consultation ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS block FROM fl) GROUP BY consultation, block),
o AS (SELECT *, row_number() OVER (PARTITION BY consultation ORDER BY start) AS k FROM bt),
w AS (SELECT consultation, k, start AS ws, "end", 0 AS win FROM o WHERE k = 1
  UNION ALL SELECT o.consultation, o.k, CASE WHEN o."end" - w.ws <= 30 THEN w.ws ELSE o.start END, o."end", CASE WHEN o."end" - w.ws <= 30 THEN w.win ELSE w.win + 1 END FROM w JOIN o ON o.consultation = w.consultation AND o.k = w.k + 1)""",
  """SELECT consultation, CAST(win AS INT) AS "window", round(min(ws), 6) AS start, round(max("end"), 6) AS "end", CAST(count(*) AS INT) AS n_blocks FROM w GROUP BY consultation, win""")
def iv_windows(spark, d):
    return rounded(intervals.windows(intervals.block_table(utterances(spark, d), ["consultation"]), ["consultation"]))


@query("iv_turns", UTT, """SELECT consultation, idx, round(cs, 6) AS clip_start, round(ce, 6) AS clip_end FROM (SELECT *, greatest(0, start - 0.2) AS cs, least(total, "end" + 0.2) AS ce FROM (
  SELECT *, max("end") OVER (PARTITION BY consultation) AS total FROM utt)) WHERE trim(text) <> '' AND ce - cs >= 0.3""")
def iv_turns(spark, d):
    return rounded(intervals.turns(utterances(spark, d), ["consultation"]).select("consultation", "idx", "clip_start", "clip_end"))


_PAD = """SELECT consultation, idx, round(greatest(0, start - least(0.5, l, room)), 6) AS lo, round(least(total, "end" + least(0.5, rr, room)), 6) AS hi FROM (SELECT *, greatest(0, (30 - ("end" - start)) / 2) AS room,
  greatest(0, (start - coalesce(lag("end") OVER w, 0)) / 2) AS l, greatest(0, (coalesce(lead(start) OVER w, total) - "end") / 2) AS rr FROM (SELECT *, max("end") OVER (PARTITION BY consultation) AS total FROM utt) WINDOW w AS (PARTITION BY consultation ORDER BY start, "end"))"""


@query("win_pad_neighbours", UTT, _PAD)
def win_pad_neighbours(spark, d):
    u = utterances(spark, d).withColumn("total", F.max("end").over(Window.partitionBy("consultation")))
    return rounded(intervals.padded(u, ["consultation"], F.col("total")).select("consultation", "idx", "lo", "hi"))


@query("iv_reference_concat", UTT, "SELECT consultation, string_agg(text, chr(10) ORDER BY start, role, text) AS reference FROM utt GROUP BY consultation")
def iv_reference_concat(spark, d):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "role", "text"))), lambda x: x["text"]), "\n")
    return utterances(spark, d).groupBy("consultation").agg(joined.alias("reference"))


@query("win_turn_changes", UTT, "SELECT consultation, CAST(1 + sum(CASE WHEN role <> prev THEN 1 ELSE 0 END) AS BIGINT) AS n_turns FROM (SELECT consultation, role, lag(role) OVER (PARTITION BY consultation ORDER BY idx) AS prev FROM utt) GROUP BY consultation")
def win_turn_changes(spark, d):
    return windows.speaker_changes(utterances(spark, d), ["consultation"])


@query("agg_list_consultations", UTT, """SELECT consultation, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, round(max("end"), 6) AS seconds FROM utt GROUP BY consultation""")
def agg_list_consultations(spark, d):
    return rounded(utterances(spark, d).groupBy("consultation").agg(F.count(F.lit(1)).alias("n_turns"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.max("end").alias("seconds")))


@query("iv_clip_pad", UTT, """SELECT consultation, idx, round(lo, 6) AS lo, round(greatest(least("end" + 0.3, total), lo + 0.001), 6) AS hi FROM (SELECT *, greatest(start - 0.3, 0) AS lo, max("end") OVER (PARTITION BY consultation) AS total FROM utt)""")
def iv_clip_pad(spark, d):
    u = utterances(spark, d).withColumn("total", F.max("end").over(Window.partitionBy("consultation")))
    lo, hi = intervals.clip_pad(F.col("start"), F.col("end"), F.col("total"))
    return rounded(u.select("consultation", "idx", lo.alias("lo"), hi.alias("hi")))


@query("iv_coverage_bits", UTT, """SELECT consultation, bin, CAST(bit_or(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 4 END) AS INT) AS bits FROM utt, range(CAST(floor(start / 5) AS BIGINT), CAST(floor("end" / 5) AS BIGINT) + 1) AS t(bin) GROUP BY consultation, bin""")
def iv_coverage_bits(spark, d):
    bit = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(4)
    return intervals.coverage_bits(utterances(spark, d), ["consultation"], F.floor(F.col("start") / 5), F.floor(F.col("end") / 5), bit)


@query("iv_transcript_export", UTT, """SELECT consultation, string_agg('[' || CAST(floor(start / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(start) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || upper(role) || ': ' || text, chr(10) ORDER BY idx) AS lines FROM utt GROUP BY consultation""")
def iv_transcript_export(spark, d):
    stamp = F.format_string("[%d:%s] %s: %s", F.floor(F.col("start") / 60), F.lpad((F.floor("start") % 60).cast("string"), 2, "0"), F.upper("role"), F.col("text"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", stamp.alias("line")))), lambda x: x["line"]), "\n")
    return utterances(spark, d).groupBy("consultation").agg(lines.alias("lines"))


@query("iv_spread_even", WORDS, "SELECT unit_id, pos, round(pos * 60.0 / count(*) OVER (PARTITION BY unit_id), 6) AS t FROM words")
def iv_spread_even(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("unit_id"))
    return rounded(words(spark, d).select("unit_id", "pos", intervals.spread_even(F.col("pos"), n, F.lit(60.0)).alias("t")))


@query("iv_spread_chars", WORDS, """SELECT unit_id, pos, round(0.1::DOUBLE + (61.7320508::DOUBLE - 0.2::DOUBLE) * (u - s) / a, 6) AS t0, round(0.1::DOUBLE + (61.7320508::DOUBLE - 0.2::DOUBLE) * u / a, 6) AS t1 FROM (SELECT unit_id, pos, length(token) + 1 AS s, sum(length(token) + 1) OVER (PARTITION BY unit_id ORDER BY pos) AS u, sum(length(token) + 1) OVER (PARTITION BY unit_id) AS a FROM words)""")
def iv_spread_chars(spark, d):
    return rounded(intervals.spread_chars(words(spark, d).withColumn("duration", F.lit(61.7320508)), ["unit_id"]).select("unit_id", "pos", "t0", "t1"))


_FLAG = "p >= 0.85"


@query("iv_merge_flags", WORDS, f"""SELECT unit_id, min(pos) AS first, max(pos) AS last, count(*) AS n, round(max(p), 6) AS top_score FROM (SELECT *, pos - row_number() OVER (PARTITION BY unit_id ORDER BY pos) AS i FROM words WHERE {_FLAG}) GROUP BY unit_id, i""")
def iv_merge_flags(spark, d):
    w = words(spark, d).filter(_FLAG)
    return rounded(intervals.merge_flags(w, ["unit_id"], F.lit(True)))


@query("iv_review_tally", WORDS, """SELECT unit_id, count(*) FILTER (p >= 0.85 AND correct = 0) AS caught, count(*) FILTER (p < 0.85 AND correct = 0) AS missed, count(*) FILTER (p >= 0.85 AND correct = 1) AS confirmed FROM words GROUP BY unit_id""")
def iv_review_tally(spark, d):
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return words(spark, d).groupBy("unit_id").agg(n("p >= 0.85 AND correct = 0").alias("caught"), n("p < 0.85 AND correct = 0").alias("missed"), n("p >= 0.85 AND correct = 1").alias("confirmed"))


@query("win_rolling_mean5", WORDS, "SELECT unit_id, pos, round(avg(p) OVER (PARTITION BY unit_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5 FROM words")
def win_rolling_mean5(spark, d):
    return rounded(words(spark, d).select("unit_id", "pos", windows.rolling_mean("p", ["unit_id"]).alias("mean5")))


@query("win_run_length", WORDS, """SELECT unit_id, pos, CASE WHEN f THEN count(*) OVER (PARTITION BY unit_id, f, i) ELSE 0 END AS run FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY pos) - row_number() OVER (PARTITION BY unit_id, f ORDER BY pos) AS i FROM (SELECT *, p < 0.3 AS f FROM words))""")
def win_run_length(spark, d):
    return windows.run_length(words(spark, d), ["unit_id"], F.col("p") < 0.3).select("unit_id", "pos", "run")


@query("win_prev_next", WORDS, "SELECT unit_id, pos, lag(p, 1, 1.0) OVER w AS prev_p, lead(p, 1, 1.0) OVER w AS next_p FROM words WINDOW w AS (PARTITION BY unit_id ORDER BY pos)")
def win_prev_next(spark, d):
    return windows.neighbours(words(spark, d), ["unit_id"]).select("unit_id", "pos", "prev_p", "next_p")


@query("win_position", WORDS, "SELECT unit_id, pos, round(pos / greatest(n - 1, 1)::DOUBLE, 6) AS rel, round(pos / n::DOUBLE, 6) AS gap, pos = 0 OR pos = n - 1 AS edge FROM (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM words)")
def win_position(spark, d):
    return rounded(windows.relative_position(words(spark, d), ["unit_id"]).select("unit_id", "pos", "rel", "gap", "edge"))


@query("win_runs_of_status", WORDS, """, s AS (SELECT unit_id, pos, CASE WHEN (unit_id * 7 + pos // 5) % 3 = 0 THEN 'D' WHEN (unit_id * 7 + pos // 5) % 3 = 1 THEN 'I' ELSE 'C' END AS status FROM words)
SELECT unit_id, status, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_words FROM (SELECT unit_id, status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY pos) - row_number() OVER (PARTITION BY unit_id, status ORDER BY pos) AS i FROM s) WHERE status IN ('D', 'I') GROUP BY unit_id, status, i HAVING count(*) >= 4) GROUP BY unit_id, status""")
def win_runs_of_status(spark, d):
    k = (F.col("unit_id") * 7 + F.floor(F.col("pos") / 5)) % 3
    s = words(spark, d).withColumn("status", F.when(k == 0, "D").when(k == 1, "I").otherwise("C"))
    return windows.runs_of(s, ["unit_id"], "status", ["D", "I"])


_TOKS = r"toks AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS t FROM documents)"


@query("win_trigram_repeat", _TOKS, "SELECT unit_id, CASE WHEN len(t) < 3 THEN 0.0 ELSE round(1 - len(list_distinct([t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2] FOR i IN range(1, len(t) - 1)])) / (len(t) - 2)::DOUBLE, 6) END AS rep3 FROM toks")
def win_trigram_repeat(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), tokens_of(F.lower("text")).alias("t"))
    return rounded(t.select("unit_id", windows.trigram_repeat(F.col("t")).alias("rep3")))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Texts with units, acronyms, tags and fillers worked in, so that the patterns have work."""
    body = F.concat(F.lit("OK. 5 mg/dl um <UNIN/> "), F.col("text"), F.lit(" <UNSURE>ohh</UNSURE> 7 mm alright"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), body.alias("text"))


_DOCS = "docs AS (SELECT doc_id AS unit_id, 'OK. 5 mg/dl um <UNIN/> ' || text || ' <UNSURE>ohh</UNSURE> 7 mm alright' AS text FROM documents)"
_UNIN = r"'(?i)<\s*(?:UNIN|INAUDIBLE_SPEECH)\s*/?\s*>'"
_TAG = r"'</?\s*[A-Za-z_]+\s*/?\s*>'"


@query("tx_strip_tags", _DOCS, rf"SELECT unit_id, trim(regexp_replace(regexp_replace(regexp_replace(text, {_UNIN}, ' ', 'g'), {_TAG}, ' ', 'g'), '[ \t]+', ' ', 'g'), ' ') AS text FROM docs")
def tx_strip_tags(spark, d):
    return _docs(spark, d).select("unit_id", text.strip_tags(F.col("text")).alias("text"))


@query("tx_has_unin", _DOCS, f"SELECT unit_id, regexp_matches(text, {_UNIN}) AS has_unin FROM docs")
def tx_has_unin(spark, d):
    return _docs(spark, d).select("unit_id", text.has_unintelligible(F.col("text")).alias("has_unin"))


@query("tx_display_clean", _DOCS, rf"SELECT unit_id, trim(regexp_replace(regexp_replace(regexp_replace(text, {_UNIN}, ' [inaudible] ', 'g'), {_TAG}, ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM docs")
def tx_display_clean(spark, d):
    return _docs(spark, d).select("unit_id", text.display_clean(F.col("text")).alias("text"))


@query("tx_training_text", _DOCS, rf"SELECT unit_id, trim(regexp_replace(regexp_replace(text, {_TAG}, ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM docs")
def tx_training_text(spark, d):
    return _docs(spark, d).select("unit_id", F.trim(F.regexp_replace(F.regexp_replace("text", text.TAG, " "), r"\s+", " ")).alias("text"))


@query("tx_snippet", _DOCS, "SELECT unit_id, substr(text, 1, 140) AS snippet FROM docs")
def tx_snippet(spark, d):
    return _docs(spark, d).select("unit_id", F.substring("text", 1, 140).alias("snippet"))


@query("tx_variants")
def tx_variants(spark, d):
    return _docs(spark, d).select("unit_id", text.variants(F.col("text")).alias("text"))


@query("tx_pieces")
def tx_pieces(spark, d):
    return _docs(spark, d).select("unit_id", F.posexplode(text.pieces(F.col("text"))).alias("pos", "piece"))


@query("tx_normalize")
def tx_normalize(spark, d):
    return _docs(spark, d).select("unit_id", F.array_join(text.plain_tokens(text.strip_tags(F.col("text"))), " ").alias("text"))


@query("tx_reference_tokens")
def tx_reference_tokens(spark, d):
    return _docs(spark, d).select("unit_id", text.reference_tokens(F.regexp_replace("text", r"<(?!/?UNIN|/?UNSURE)", " ")).alias("tokens"))


@query("tx_collapse_repeats")
def tx_collapse_repeats(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), tokens_of(F.lower("text")).alias("t"))
    return t.select("unit_id", text.collapse_repeats("t").alias("kept"))


_NEG = "(" + ", ".join(f"'{w}'" for w in text.NEGATIONS) + ")"
_COUNT = "(" + ", ".join(f"'{w}'" for w in text.COUNT_WORDS) + ")"
_ONE = "(" + ", ".join(f"'{w}'" for w in text.ONE_BEFORE) + ")"
_FUNC = "(" + ", ".join(f"'{w}'" for w in text.FUNCTION_WORDS) + ")"
_NUM = rf"token <> '<*>' AND NOT regexp_matches(token, '^\d+(st|nd|rd|th)$') AND (regexp_matches(token, '\d') OR token IN {_COUNT} OR (token = 'one' AND coalesce(nxt IN {_ONE}, false)))"
_NEXT = WORDS + ", nw AS (SELECT unit_id, pos, token, lead(token) OVER (PARTITION BY unit_id ORDER BY pos) AS nxt FROM words)"


def _next(spark, d):
    return words(spark, d).select("unit_id", "pos", "token", F.lead("token").over(Window.partitionBy("unit_id").orderBy("pos")).alias("nxt"))


@query("tx_is_number", _NEXT, f"SELECT unit_id, pos, {_NUM} AS is_number FROM nw")
def tx_is_number(spark, d):
    return _next(spark, d).select("unit_id", "pos", text.is_number(F.col("token"), F.col("nxt")).alias("is_number"))


@query("tx_is_critical", _NEXT, f"SELECT unit_id, pos, token IN {_NEG} OR ({_NUM}) AS is_critical FROM nw")
def tx_is_critical(spark, d):
    return _next(spark, d).select("unit_id", "pos", (text.is_negation(F.col("token")) | text.is_number(F.col("token"), F.col("nxt"))).alias("is_critical"))


@query("tx_categories", _NEXT + ", " + LEX, f"SELECT cat, count(*) AS n, round(sum(CASE cat WHEN 'crit' THEN 10 WHEN 'med' THEN 5 WHEN 'func' THEN 0.2::DOUBLE ELSE 1 END), 4) AS weight FROM (SELECT CASE WHEN token IN {_NEG} OR ({_NUM}) THEN 'crit' WHEN term IS NOT NULL THEN 'med' WHEN token IN {_FUNC} THEN 'func' ELSE 'cont' END AS cat FROM nw LEFT JOIN lex ON term = token) GROUP BY cat")
def tx_categories(spark, d):
    joined = _next(spark, d).join(lexicon(spark, d).select(F.col("term").alias("token"), F.lit(True).alias("med")), "token", "left")
    cat = text.category(F.col("token"), F.col("nxt"), F.coalesce("med", F.lit(False)))
    return rounded(joined.select(cat.alias("cat")).groupBy("cat").agg(F.count(F.lit(1)).alias("n"), F.sum(text.weight(F.col("cat"))).alias("weight")), 4)


@query("tx_occurrences", _TOKS, "SELECT unit_id, [CAST(i AS INT) FOR i IN range(1, len(t)) IF t[i] = 'the' AND t[i + 1] = 'of'] AS at FROM toks")
def tx_occurrences(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), tokens_of(F.lower("text")).alias("t"))
    return t.select("unit_id", text.occurrences(F.col("t"), F.array(F.lit("the"), F.lit("of"))).alias("at"))


@query("tx_context_window", _TOKS, "SELECT unit_id, array_to_string(t[greatest(k - 6, 1):k + 6], ' ') AS context FROM (SELECT *, 1 + unit_id % greatest(len(t), 1) AS k FROM toks)")
def tx_context_window(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), tokens_of(F.lower("text")).alias("t"))
    return t.select("unit_id", text.context(F.col("t"), (1 + F.col("unit_id") % F.greatest(F.size("t"), F.lit(1))).cast("int")).alias("context"))


@query("tx_term_match", LEX + ", " + WORDS, "SELECT unit_id, CAST(pos AS INT) AS start, 1::INT AS length FROM words SEMI JOIN lex ON token = term")
def tx_term_match(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), tokens_of(F.lower("text")).alias("t"))
    return matching.term_matches(t, ["unit_id"], "t", lexicon(spark, d))


_AL = ["conv_id", "turn"]


@query("al_edit_count")
def al_edit_count(spark, d):
    return pairs(spark, d).select(*_AL, align.edit_count(F.col("ref"), F.col("hyp")).alias("edits"))


def _aligned(spark, d):
    return pairs(spark, d).withColumn("a", align.aligned("ref", "hyp"))


@query("al_align")
def al_align(spark, d):
    return _aligned(spark, d).select(*_AL, "a.*")


@query("al_counts")
def al_counts(spark, d):
    return rounded(_aligned(spark, d).select(*_AL, *(c.alias(n) for n, c in align.counts(F.col("a")).items())))


@query("al_wild_count")
def al_wild_count(spark, d):
    wild = F.concat(F.slice("ref", 1, 3), F.array(F.lit(text.WILDCARD)), F.slice("ref", F.lit(8), F.greatest(F.size("ref"), F.lit(1))))
    counted = align.counts(F.col("a"))
    return pairs(spark, d).withColumn("a", align.aligned(wild, "hyp")).select(*_AL, counted["errors"].alias("cost"), counted["absorbed"].alias("absorbed"))


@query("al_word_level")
def al_word_level(spark, d):
    return _aligned(spark, d).select(*_AL, F.posexplode(F.arrays_zip("hyp", "a.hyp_status")).alias("pos", "x")).select(*_AL, "pos", F.col("x.hyp").alias("token"), F.col("x.hyp_status").alias("status")).filter("status <> 'W'")


@query("al_labels")
def al_labels(spark, d):
    weigh = lambda c: F.transform(c, lambda t: text.weight(text.category(t, F.lit(None).cast("string"), F.lit(False))))
    return pairs(spark, d).withColumn("l", align.losses("ref", "hyp", weigh("ref"), weigh("hyp"))).select(*_AL, "l.*")


@query("al_second_opinion")
def al_second_opinion(spark, d):
    return pairs(spark, d).withColumn("o", align.second_opinion("hyp", "ref")).select(*_AL, "o.*")


@query("agg_churn")
def agg_churn(spark, d):
    one = _aligned(spark, d).select(*_AL, F.posexplode("a.ref_status").alias("pos", "s1"))
    two = pairs(spark, d).withColumn("a", align.aligned("ref", F.filter("hyp", lambda t: F.length(t) > 3))).select(*_AL, F.posexplode("a.ref_status").alias("pos", "s2"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return one.join(two, [*_AL, "pos"]).groupBy("conv_id").agg(n("s1 <> 'C' AND s2 = 'C'").alias("fixed"), n("s1 = 'C' AND s2 <> 'C'").alias("broken"), n("s1 <> 'C' AND s2 <> 'C'").alias("wrong_in_both"))


def _records(spark, d):
    """Turns as decoder records: a segment a record, words with probabilities by formula."""
    p = lambda i: ((F.col("conv_id") * 31 + F.col("turn") * 7 + i * 17) % 100 / 100.0).cast("double")
    w = F.transform(tokens_of(F.col("text")), lambda t, i: F.struct(t.alias("word"), p(i).alias("probability")))
    seg = F.struct((-p(F.lit(1)) * 2).alias("avg_logprob"), F.size("w").alias("n_tokens"), p(F.lit(2)).alias("no_speech_prob"), (p(F.lit(3)) * 3).alias("compression_ratio"), F.lit(0.0).alias("temperature"))
    return table(spark, d, "conversations").withColumn("w", w).select(*_AL, "text", (F.length("text") / F.lit(15.0)).alias("audio_s"), F.array(seg).alias("segments"), F.col("w").alias("words"))


_REC = r""", w AS (SELECT conv_id, turn, length(text) / 15.0::DOUBLE AS audio_s, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, CAST((conv_id * 31 + turn * 7 + 17) % 100 AS DOUBLE) / 100 AS p1, CAST((conv_id * 31 + turn * 7 + 34) % 100 AS DOUBLE) / 100 AS p2 FROM conversations)"""


@query("ft_unit_features", _REC.removeprefix(", "), """SELECT conv_id, turn, round(-2 * p1, 6) + 0.0 AS mean_logprob, round(p2, 6) AS nsp_max, round(ln(1 + n), 6) AS log_words, round(n / greatest(audio_s, 0.05), 6) AS words_per_s, round(exp(-2 * p1), 6) AS conf FROM w WHERE n > 0""")
def ft_unit_features(spark, d):
    f = features.unit_features(_records(spark, d)).filter(F.size("words") > 0)
    return rounded(f.select(*_AL, "mean_logprob", "nsp_max", "log_words", "words_per_s", "conf"))


@query("ft_unit_features_all")
def ft_unit_features_all(spark, d):
    f = features.unit_features(_records(spark, d))
    return rounded(f.select(*_AL, *features.EMPTY, "log_duration"))


def _items(spark, d):
    """Every word as a clip of its turn, five words to a second, with scores by formula; a turn of n words lasts to the end of its last clip."""
    w = table(spark, d, "conversations").withColumn("tokens", tokens_of(F.col("text")))
    w = w.select(F.col("conv_id").alias("consultation"), F.col("turn").cast("string").alias("unit"), "turn", F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("pos", "token"))
    k = (F.col("consultation") * 13 + F.col("pos") * 7) % 10
    p = lambda i: ((F.col("consultation") * 31 + F.col("turn") * 7 + i * 17) % 100 / 100.0).cast("double")
    return w.select(
        "consultation", "unit", (F.col("pos") / 5.0).alias("a"), (F.col("pos") / 5.0 + 0.8).alias("b"), (k / 10.0 + 0.1).cast("double").alias("pred"), (k % 2).cast("double").alias("true"), (k % 3).cast("double").alias("crit"),
        p(F.col("pos")).alias("p"), F.exp(-2 * p(F.lit(1))).alias("conf"), F.when(F.col("n") > 0, F.col("n") / 5.0 + 0.6).otherwise(0.0).cast("double").alias("duration"),
    )


@query("iv_curve_parts")
def iv_curve_parts(spark, d):
    return rounded(review.review_curves(_items(spark, d), [0, 5, 10, 20, 40], review.FIVE))


@query("iv_marginal_queue")
def iv_marginal_queue(spark, d):
    return rounded(review.review_curves(_items(spark, d), [5, 10, 20], ["queue"]))


@query("iv_hybrid_greedy")
def iv_hybrid_greedy(spark, d):
    return rounded(review.review_curves(_items(spark, d), [5, 10, 20], ["hybrid"]))


@query("agg_curve_summary")
def agg_curve_summary(spark, d):
    return review.curve_summary(review.review_curves(_items(spark, d), [0, 5, 10, 20, 40], review.FIVE))


@query("iv_window_review", UTT, """, c AS (SELECT consultation, idx, length(text) AS v, sum("end" - start) OVER (PARTITION BY consultation ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) AS spent FROM utt), b(budget) AS (VALUES (10.0::DOUBLE), (30.0::DOUBLE))
SELECT consultation, budget, CAST(coalesce(sum(CASE WHEN spent <= budget + 1e-9 THEN v END), 0) AS BIGINT) AS caught, CAST(sum(v) AS BIGINT) AS total FROM c, b GROUP BY consultation, budget""")
def iv_window_review(spark, d):
    u = utterances(spark, d).withColumns({"seconds": F.col("end") - F.col("start"), "v": F.length("text").cast("long")})
    return windows.caught_within(u, ["consultation"], [10, 30], F.col("idx").desc(), "seconds", "v", "idx")
