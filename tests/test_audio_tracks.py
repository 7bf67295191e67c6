"""Shares of two-channel tracks and audio columns against loops."""

import math
import random

import pytest

from triagelake.operators import speech


@pytest.fixture(scope="module")
def recordings():
    rng = random.Random(4)
    return {"long": ([rng.random() < 0.6 for _ in range(205)], [rng.random() < 0.4 for _ in range(230)]), "even": ([True] * 64, [i % 2 > 0 for i in range(64)]), "one": ([True] * 20, None)}


@pytest.fixture(scope="module")
def track(spark, recordings):
    rows = [(r, role, h, s) for r, both in recordings.items() for role, mask in zip(("doctor", "patient"), both) for h, s in enumerate(mask or [])]
    return speech.pack_track(spark.createDataFrame(rows, "rec string, role string, hop long, speech boolean"), "rec")


def share(recordings, rec, kind, a, b, hop):
    doctor, patient = recordings.get(rec, (None, None))
    if doctor is None or patient is None:
        return None
    n = min(len(doctor), len(patient))
    held = [{"doctor": x, "patient": y, "both": x and y, "any": x or y}[kind] for x, y in zip(doctor, patient)]
    ia = min(max(math.floor(a / hop), 0), n)
    ib = max(min(max(math.ceil(b / hop), 0), n), ia + 1)
    return sum(held[ia:ib]) / (ib - ia)


def test_tracks(track):
    found = {(r["rec"], r["block"]): r for r in track.collect()}
    assert {k for k in found} == {("long", i) for i in range(7)} | {("even", i) for i in range(3)}
    assert found["even", 1]["before_any"] == 32 and found["even", 2]["before_both"] == 32 and found["long", 0]["n"] == 205


def test_audio_columns_against_a_loop(spark, recordings, track):
    rng, hop, rows = random.Random(5), 0.25, []
    for i in range(200):
        a, t = rng.uniform(-2, 60), rng.uniform(-1, 58)
        rows.append((i, rng.choice(["long", "even", "one", "none"]), rng.choice(["word", "gap"]), t, t if i % 2 else t + rng.random(), rng.choice(["doctor", "patient", None]), a, a + rng.uniform(0, 9), rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "i int, rec string, kind string, t0 double, t1 double, role string, start double, end double, n_words int")
    found = {r["i"]: r for r in speech.audio_columns(df, track, "rec", hop).collect()}
    assert len(found) == 200
    for i, rec, kind, t0, t1, role, start, end, n in rows:
        own, other = (role, {"doctor": "patient", "patient": "doctor"}[role]) if role else ("any", "both")
        pad = speech.WORD_PAD if kind == "word" else speech.GAP_PAD
        r, near = found[i], lambda x, y: x is None and y is None or abs(x - y) < 1e-9
        assert all(near(r[c], share(recordings, rec, k, t0 - pad, t1 + pad, hop)) for c, k in (("ov", "both"), ("other", other), ("own", own)))
        seconds = share(recordings, rec, own, start, end, hop)
        seconds = None if seconds is None else seconds * (end - start)
        assert near(r["u_own_s"], seconds) and near(r["u_ov"], share(recordings, rec, "both", start, end, hop)) and r["two_ch"] == float(seconds is not None)
        assert near(r["u_wps"], n / seconds if seconds is not None and seconds > 0.05 else None)
