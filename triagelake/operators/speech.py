"""Two-channel speech tracks: frame levels, masks and shares over time spans by cumulative sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators import quantiles, scans
from triagelake.sources.records import written

#: Hops in a packed block of a track, a bit each.
BLOCK = 32
# Seconds that are added on both sides of a word, and of a gap.
WORD_PAD, GAP_PAD = 0.3, 0.6
KINDS = ("doctor", "patient", "both", "any")

Keys = Sequence[str]


def frame_levels(samples: DataFrame, keys: Keys, frame: int, hop: int, value: str = "x", pos: str = "pos") -> DataFrame:
    """(keys, hop, db): RMS level of each whole frame of samples; levels don't fall below -100 dB."""
    line = Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, frame - 1)
    power = samples.withColumns({"__p": F.avg(F.col(value) * F.col(value)).over(line), "__n": F.count(F.lit(1)).over(line)})
    whole = power.filter((F.col("__n") == frame) & (F.col(pos) % hop == 0))
    return whole.select(*keys, F.floor(F.col(pos) / hop).alias("hop"), (F.lit(10.0) * F.log10(F.greatest("__p", F.lit(1e-10)))).alias("db"))


def speech_mask(levels: DataFrame, keys: Keys, above: float = 12.0) -> DataFrame:
    """Adds speech: more than `above` dB over the 20th percentile of the channel."""
    floor = quantiles.exact(levels, keys, "db", {"__floor": 0.2})
    return levels.join(floor, list(keys)).withColumn("speech", F.col("db") > F.col("__floor") + above).drop("__floor")


def cumulative(mask: DataFrame, keys: Keys, flag: str = "speech") -> DataFrame:
    """Adds upto: flagged hops before each hop."""
    line = Window.partitionBy(*keys).orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    return mask.withColumn("upto", F.sum(F.col(flag).cast("int")).over(line) - F.col(flag).cast("int"))


def share_of_span(spans: DataFrame, track: DataFrame, keys: Keys, lo: Column, hi: Column) -> DataFrame:
    """Adds share: the part of hops lo to hi (at least one) that is flagged, by two lookups in the cumulative track."""
    flat = track.select(*keys, F.col("hop").alias("__hop"), F.col("upto").alias("__upto"))
    cut = spans.withColumns({"__lo": lo, "__hi": F.greatest(hi, lo + 1)})
    out = cut.join(flat.withColumnsRenamed({"__hop": "__lo", "__upto": "__a"}), [*keys, "__lo"]).join(flat.withColumnsRenamed({"__hop": "__hi", "__upto": "__b"}), [*keys, "__hi"])
    return out.withColumn("share", (F.col("__b") - F.col("__a")) / (F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi", "__a", "__b")


def pack_track(mask: DataFrame, recording: str, role: str = "role", roles: tuple[str, str] = ("doctor", "patient")) -> DataFrame:
    """The two-channel track of each recording, packed and written once: (recording, n, block, doctor, patient, before_...), a row for BLOCK hops.

    `mask` has recording, role, hop and speech. doctor and patient are the blocks' bits, before_doctor, before_patient, before_both and before_any count the hops before the block in which
    each holds. n is the number of hops that both channels have; a recording without one of the channels has no track. The blocks of a long recording are rows of their own, summed in ranges.
    """
    one, two = roles
    sizes = mask.groupBy(recording).agg(*(F.max(F.when(F.col(role) == r, F.col("hop"))).alias(f"__{r}") for r in roles)).filter(F.col(f"__{one}").isNotNull() & F.col(f"__{two}").isNotNull())
    sizes = sizes.select(recording, (F.least(f"__{one}", f"__{two}") + 1).alias("n"))
    bits = lambda r: F.bit_or(F.when((F.col(role) == r) & F.col("speech"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("hop") % BLOCK).cast("int"))))
    used = mask.join(sizes, recording).filter(F.col("hop") < F.col("n"))
    packed = used.groupBy(recording, F.floor(F.col("hop") / BLOCK).alias("block")).agg(bits(one).alias("doctor"), bits(two).alias("patient"))
    # The block that n itself falls in is there even if it has no hop.
    blocks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))))
    rows = blocks.join(packed, [recording, "block"], "left").fillna(0, ["doctor", "patient"])
    held = {k: F.bit_count(c).cast("long") for k, c in _kinds().items()}
    summed = scans.running(rows, [recording], ["block"], {f"upto_{k}": c for k, c in held.items()})
    return written(summed.select(recording, "n", "block", "doctor", "patient", *((F.col(f"upto_{k}") - c).alias(f"before_{k}") for k, c in held.items())))


def _kinds() -> dict[str, Column]:
    one, two = F.col("doctor"), F.col("patient")
    return {"doctor": one, "patient": two, "both": one.bitwiseAND(two), "any": one.bitwiseOR(two)}


def span_shares(spans: DataFrame, track: DataFrame, recording: str, a: Column, b: Column, hop_s: float) -> DataFrame:
    """Adds doctor, patient, both and any: the share of the hops of [a, b) seconds, at least one, in which each holds; null without a track or a span.

    Any number of spans share a track: a share is the difference of two lookups, a block's count and its bits below the hop.
    """
    sizes = track.filter("block = 0").select(F.col(recording).alias("__rec"), F.col("n").alias("__hops"))
    cut = spans.join(sizes, F.col(recording) == F.col("__rec"), "left").drop("__rec")
    inside = lambda t: F.greatest(F.least(t, F.col("__hops")), F.lit(0))
    cut = cut.withColumn("__ia", F.when(F.col("__hops").isNotNull() & a.isNotNull(), inside(F.floor(a / hop_s)))).withColumn("__ib", F.when(F.col("__ia").isNotNull() & b.isNotNull(), F.greatest(inside(F.ceil(b / hop_s)), F.col("__ia") + 1)))
    for name, at in (("a", F.col("__ia")), ("b", F.least("__ib", "__hops"))):
        below = F.call_function("shiftleft", F.lit(1).cast("long"), (at % BLOCK).cast("int")) - 1
        look = track.select(F.col(recording).alias("__rec"), F.col("block").alias("__block"), F.struct(*_kinds_at(track)).alias(f"__t{name}"))
        cut = cut.withColumn("__at", F.floor(at / BLOCK)).join(look, (F.col(recording) == F.col("__rec")) & (F.col("__at") == F.col("__block")), "left").drop("__rec", "__block", "__at")
        cut = cut.withColumns({f"__{name}_{k}": F.col(f"__t{name}.before_{k}") + F.bit_count(F.col(f"__t{name}.{k}").bitwiseAND(below)) for k in KINDS}).drop(f"__t{name}")
    out = cut.withColumns({k: (F.col(f"__b_{k}") - F.col(f"__a_{k}")) / (F.col("__ib") - F.col("__ia")) for k in KINDS})
    return out.drop("__hops", "__ia", "__ib", *(f"__{n}_{k}" for n in "ab" for k in KINDS))


def _kinds_at(track: DataFrame) -> list[Column]:
    return [*(c.alias(k) for k, c in _kinds().items()), *(F.col(f"before_{k}") for k in KINDS)]


def audio_columns(items: DataFrame, track: DataFrame, recording: str, hop_s: float) -> DataFrame:
    """Adds ov, other, own, u_ov, u_own_s, u_wps and two_ch to words and gaps of units, on the track of their recording.

    Items have kind (word or gap), t0 and t1 (the same for a gap), and of their unit role (doctor, patient, or null for both channels), start, end and n_words. other and own are the other
    channel and the role's; with both, what any and both say. Words are taken with WORD_PAD, gaps with GAP_PAD on both sides. u_wps is null where the unit's own speech is 0.05 s at most. Without a track
    all are null and two_ch is 0.
    """
    own = F.when(F.col("role") == "doctor", F.col("doctor")).when(F.col("role") == "patient", F.col("patient")).otherwise(F.col("any"))
    other = F.when(F.col("role") == "doctor", F.col("patient")).when(F.col("role") == "patient", F.col("doctor")).otherwise(F.col("both"))
    pad = F.when(F.col("kind") == "word", F.lit(WORD_PAD)).otherwise(F.lit(GAP_PAD))
    out = span_shares(items, track, recording, F.col("t0") - pad, F.col("t1") + pad, hop_s).withColumns({"ov": F.col("both"), "__other": other, "__own": own}).drop(*KINDS)
    out = span_shares(out, track, recording, F.col("start"), F.col("end"), hop_s).withColumns({"u_ov": F.col("both"), "u_own_s": own * F.greatest(F.col("end") - F.col("start"), F.lit(0.0))}).drop(*KINDS)
    speaking = F.when(F.col("u_own_s") > 0.05, F.col("n_words") / F.col("u_own_s"))
    return out.withColumns({"u_wps": speaking, "two_ch": F.when(F.col("u_ov").isNull(), 0.0).otherwise(1.0)}).withColumnsRenamed({"__other": "other", "__own": "own"})
