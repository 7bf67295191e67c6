"""Queries on the verifier's tables, on validation, content keys and the append-only log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.functions import align, text, verifier
from triagelake.operators import boosting
from triagelake.plans.registry import Registry, rounded
from triagelake.plans.views import UNITS, pairs, table, units
from triagelake.sources import records

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add
_KEYS = ["conv_id", "turn"]


def _p(i):
    """The probability of token i of a turn, by formula."""
    return ((F.col("conv_id") * 31 + F.col("turn") * 7 + i * 17) % 100 / 100.0).cast("double")


@query("tx_scoring_tokens")
def tx_scoring_tokens(spark, d):
    return table(spark, d, "conversations").select(*_KEYS, text.scoring_tokens(F.col("text")).alias("tokens"))


@query("tx_english_norm")
def tx_english_norm(spark, d):
    return table(spark, d, "conversations").select(*_KEYS, F.array_join(text.plain_tokens(F.col("text")), " ").alias("text"))


@query("tx_hyp_tokens")
def tx_hyp_tokens(spark, d):
    turns = table(spark, d, "conversations").select(*_KEYS, verifier.hyp_tokens(F.split("text", " ")).alias("t"))
    return turns.select(*_KEYS, F.posexplode(F.arrays_zip("t.tokens", "t.owner")).alias("at", "x")).select(*_KEYS, "at", F.col("x.tokens").alias("token"), F.col("x.owner").alias("owner"))


@query("al_rover_tokens")
def al_rover_tokens(spark, d):
    words = F.split("text", " ")
    turns = table(spark, d, "conversations").withColumn("t", verifier.hyp_tokens(words)).withColumn("probs", F.when(F.col("turn") % 3 > 0, F.transform(words, lambda w, i: _p(i))))
    scored = turns.withColumn("p", verifier.token_probabilities(F.col("t.owner"), F.col("probs"), _p(F.lit(2))))
    return scored.select(*_KEYS, F.posexplode(F.arrays_zip("t.tokens", "p")).alias("at", "x")).select(*_KEYS, "at", F.col("x.tokens").alias("token"), "x.p")


@query("src_rescored_units")
def src_rescored_units(spark, d):
    unit = F.concat_ws("-", "conv_id", "turn").alias("unit_id")
    turns = pairs(spark, d)
    clean = lambda c: F.regexp_replace(F.array_join(c, " "), "[<>]", " ")
    return rounded(align.score_units(turns.select(unit, clean("hyp").alias("text")), turns.select(unit, clean("ref").alias("reference")), "unit_id"))


@query("al_p_full")
def al_p_full(spark, d):
    wild = F.concat(F.slice("ref", 1, 3), F.array(F.lit(text.WILDCARD)), F.slice("ref", F.lit(8), F.greatest(F.size("ref"), F.lit(1))))
    scored = pairs(spark, d).withColumn("a", align.aligned(wild, "hyp")).withColumn("p", F.transform(F.filter("a.hyp_status", lambda s: s != "W"), lambda s, i: _p(i)))
    return scored.select(*_KEYS, verifier.p_full("p", "a.hyp_status", F.when(F.col("turn") % 3 > 0, _p(F.lit(3)))).alias("p_full"))


def _verified(spark, d):
    """Each turn's next one as the second transcript, with probabilities and decoder statistics by formula."""
    stats = [_p(F.lit(i)).alias(c) for i, c in enumerate(c for c in verifier.UNIT if c != "n_words")]
    scored = lambda c: F.transform(c, lambda t, i: _p(i))
    return pairs(spark, d).select(*_KEYS, F.col("ref").alias("tokens"), scored("ref").alias("p"), F.when(F.col("turn") % 4 > 0, F.col("hyp")).alias("other"), F.when(F.col("turn") % 2 > 0, scored("hyp")).alias("other_p"), *stats)


@query("ft_unit_tables")
def ft_unit_tables(spark, d):
    return rounded(verifier.word_and_gap_tables(_verified(spark, d), _KEYS)[0])


@query("ft_unit_tables_gaps")
def ft_unit_tables_gaps(spark, d):
    return rounded(verifier.word_and_gap_tables(_verified(spark, d), _KEYS)[1])


@query("al_gaps_after_words")
def al_gaps_after_words(spark, d):
    gaps = verifier.word_and_gap_tables(_verified(spark, d), _KEYS)[1].select(*_KEYS, "at", F.col("right_p").alias("score"), "suggestion")
    owners = _verified(spark, d).select(*_KEYS, F.posexplode("tokens").alias("at", "token")).select(*_KEYS, "at", F.floor(F.col("at") / 2).cast("int").alias("owner"))
    return rounded(verifier.gap_after(gaps, owners, _KEYS))


def _decoded(spark, d):
    """Turns as decoded units: display words, tokens with their owners, the next turn as the reference and the one after it as the second transcript."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumns({"next": F.lead("text").over(line), "third": F.lead("text", 2).over(line)}).filter("next IS NOT NULL")
    stats = [_p(F.lit(i)).alias(c) for i, c in enumerate(c for c in verifier.UNIT if c != "n_words")]
    words = F.split("text", " ")
    turns = turns.withColumn("t", verifier.hyp_tokens(words)).withColumn("probs", F.transform(words, lambda w, i: _p(i)))
    return turns.select(
        *_KEYS, words.alias("words"), "t.owner", F.col("t.tokens").alias("tokens"), verifier.token_probabilities(F.col("t.owner"), F.col("probs"), _p(F.lit(2))).alias("p"),
        text.scoring_tokens(F.col("next")).alias("ref"), F.when(F.col("third").isNotNull(), text.scoring_tokens(F.col("third"))).alias("other"), F.lit(None).cast("array<double>").alias("other_p"), *stats,
    )


def training_tables(spark, d):
    """Word and gap tables with b, the weighted error that checking the word or gap would mend."""
    decoded = records.written(_decoded(spark, d))
    lost = decoded.select(*_KEYS, align.losses("ref", "tokens", verifier.weights(F.col("ref")), verifier.weights(F.col("tokens"))).alias("l"))
    at = lambda c: lost.select(*_KEYS, F.posexplode(f"l.{c}").alias("at", "b"))
    words, gaps = verifier.word_and_gap_tables(decoded, _KEYS)
    return records.written(words.join(at("word_loss"), [*_KEYS, "at"])), records.written(gaps.join(at("gap_loss"), [*_KEYS, "at"]))


#: Fewer and smaller trees than a model for use would have.
_TREES = boosting.Settings(trees=6, depth=3, rate=0.3, min_leaf=20, l2=1.0)


def _features(kind):
    return verifier.variant_features("second")[kind]


@query("ml_poisson_gbt")
def ml_poisson_gbt(spark, d):
    words, _ = training_tables(spark, d)
    models = boosting.fit(words, _features(0), "b", settings=_TREES, key=[*_KEYS, "at"])
    return rounded(boosting.predict(words, models, "prediction").select(*_KEYS, "at", "b", "prediction"))


@query("ml_verifier_score")
def ml_verifier_score(spark, d):
    tables = training_tables(spark, d)
    scored = [boosting.predict(t, boosting.fit(t, _features(i), "b", settings=_TREES, key=[*_KEYS, "at"]), "score") for i, t in enumerate(tables)]
    owners = _decoded(spark, d).select(*_KEYS, F.posexplode("owner").alias("at", "owner"))
    words, gaps = verifier.display_scores(*scored, owners, _KEYS)
    return rounded(words.select(*_KEYS, F.lit("word").alias("kind"), F.col("owner").alias("place"), "score", "critical", F.lit(None).cast("string").alias("suggestion")).unionByName(
        gaps.select(*_KEYS, F.lit("gap").alias("kind"), F.col("after").alias("place"), "score", F.lit(None).cast("boolean").alias("critical"), "suggestion")), 4)


@query("ml_crossfit_verifier")
def ml_crossfit_verifier(spark, d):
    out = []
    for i, t in enumerate(training_tables(spark, d)):
        fitted = boosting.cross_fitted(t, _features(i), "b", "conv_id", "prediction", seed=7, settings=_TREES, key=[*_KEYS, "at"])
        out.append(fitted.select(*_KEYS, F.lit(("word", "gap")[i]).alias("kind"), "at", "fold", "b", "prediction"))
    return rounded(out[0].unionByName(out[1]))


@query("sv_validate", "", """SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN turn > 5 THEN 'turn' WHEN text IS NULL OR trim(text) = '' THEN 'text' ELSE 'ok' END AS verdict FROM conversations""")
def sv_validate(spark, d):
    return records.validated(table(spark, d, "conversations"), {"role": F.col("role").isin("user", "assistant"), "turn": F.col("turn") <= 5, "text": F.trim("text") != ""}).select(*_KEYS, "verdict")


@query("st_hash_fingerprint", UNITS, """SELECT ev, md5(count(*) || ':' || CAST(sum(CAST('0x' || substr(md5(unit_id || '|' || y || '|' || errors), 1, 12) AS BIGINT)) AS BIGINT)) AS key FROM units GROUP BY ev""")
def st_hash_fingerprint(spark, d):
    return records.content_key(units(spark, d), ["ev"], ["unit_id", "y", "errors"])


@query("sink_jsonl_append", "", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def sink_jsonl_append(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("unit_id"), "conv_id", "role")
    path = records.scratch_folder(spark)
    # A first run that broke off, and a second that goes on: what is there is not written again.
    records.append_jsonl(rows.filter("role = 'user'"), path, "unit_id")
    records.append_jsonl(rows, path, "unit_id")
    found = records.read_jsonl(spark, path, "unit_id string, conv_id long, role string", "unit_id")
    return found.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"))
