"""Confidence features of decoder records, by higher-order functions over their segments and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.windows import trigram_repeat

#: What a unit without output gets: the least confident value of each feature.
EMPTY = {
    "mean_logprob": -3.0, "min_seg_logprob": -3.0, "word_p_mean": 0.0, "word_p_min": 0.0, "word_p_q10": 0.0, "word_frac_low": 1.0, "nsp_max": 1.0, "cr_max": 0.0, "rep3": 0.0,
    "fallback": 1.0, "log_words": 0.0, "words_per_s": 0.0, "n_segments": 0.0, "empty_hyp": 1.0, "conf": 0.0,
}


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    at = (F.size(sorted_values) - 1) * F.lit(float(q))
    lo = F.floor(at).cast("int")
    low, high = F.try_element_at(sorted_values, lo + 1), F.try_element_at(sorted_values, F.least(lo + 2, F.size(sorted_values)))
    return low + (high - low) * (at - lo)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def unit_features(records: DataFrame) -> DataFrame:
    """Adds the features to records with text, audio_s, segments and words (see sources.records.RECORD)."""
    seg = lambda f: F.transform("segments", lambda s: s[f].cast("double"))
    tokens = F.transform("segments", lambda s: F.greatest(s["n_tokens"], F.lit(1)).cast("double"))
    mean_lp = F.try_divide(_sum(F.zip_with(seg("avg_logprob"), tokens, lambda a, b: a * b)), _sum(tokens))
    given = F.transform("words", lambda w: w["probability"].cast("double"))
    probs = F.array_sort(F.when(F.size("words") > 0, given).otherwise(F.array(F.exp(mean_lp))))
    spoken = F.filter(F.transform("words", lambda w: F.lower(F.trim(w["word"]))), lambda w: w != "")
    duration = F.greatest(F.coalesce(F.col("audio_s"), F.lit(0.0)), F.lit(0.05))
    values = {
        "mean_logprob": mean_lp,
        "min_seg_logprob": F.array_min(seg("avg_logprob")),
        "word_p_mean": F.try_divide(_sum(probs), F.size(probs).cast("double")),
        "word_p_min": F.array_min(probs),
        "word_p_q10": quantile(probs, 0.1),
        "word_frac_low": F.try_divide(F.size(F.filter(probs, lambda p: p < 0.5)).cast("double"), F.size(probs).cast("double")),
        "nsp_max": F.array_max(seg("no_speech_prob")),
        "cr_max": F.array_max(seg("compression_ratio")),
        "rep3": trigram_repeat(spoken),
        "fallback": F.exists("segments", lambda s: s["temperature"] > 0).cast("double"),
        "log_words": F.log1p(F.size("words")),
        "words_per_s": F.size("words") / duration,
        "n_segments": F.size("segments").cast("double"),
        "empty_hyp": F.lit(0.0),
        "conf": F.exp(mean_lp),
    }
    empty = (F.coalesce(F.size("segments"), F.lit(0)) <= 0) | (F.trim(F.coalesce("text", F.lit(""))) == "")
    filled = records.withColumn("segments", F.coalesce("segments", F.slice("segments", 1, 0))).withColumn("words", F.coalesce("words", F.array().cast(records.schema["words"].dataType)))
    return filled.withColumns({**{name: F.when(empty, F.lit(EMPTY[name])).otherwise(value) for name, value in values.items()}, "log_duration": F.ln(duration)})
