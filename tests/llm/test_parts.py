"""What a worker remembers of parts of texts, as it goes from one operator to another."""

import gc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from triagelake.llm import language_id as lid
from triagelake.llm.parts import Known, Short, cuts, slices


def test_only_the_memory_used_last_is_kept():
    public = pytest.importorskip("public_tokenizers")
    from triagelake.llm import bpe

    encoder = bpe.Encoder(bpe.load(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).vocabulary, public.PATTERN)
    texts = pa.array([" ".join(f"w{i}xq{i % 7}" for i in range(5000)), "", "the end"])
    ids, starts = encoder.encode_all(texts)
    assert len(encoder.known) > 4000 and encoder.vocabulary.known_fits
    model = lid.build([("de", "einheit", 9), ("en", "station", 8)])
    first = model.predict_all(texts)
    assert not encoder.known and not encoder.vocabulary.known_fits and encoder.lists.flat.nbytes + encoder.lists.ends.nbytes < 1 << 16
    again, where = encoder.encode_all(texts)
    assert again.tolist() == ids.tolist() and where.tolist() == starts.tolist()
    assert not model._sums.known and len(model._sums.table.values) == 1 << 10
    assert model.predict_all(texts) == first


def test_a_memory_goes_with_its_owner():
    model = lid.build([("de", "einheit", 9), ("en", "station", 8)])
    model.predict("die einheit")
    gone = [weakref.ref(model), weakref.ref(model._sums), weakref.ref(model._sums.known)]
    gc.disable()
    try:
        del model
        assert [x() for x in gone] == [None] * 3
    finally:
        gc.enable()


def test_cuts_keep_nulls_and_slices_fill_them():
    rows = ["a" * 10, None, "b" * 30, "", None, "c" * 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(np.arange(len(x)))], names=["t", "i"]) for x in (rows, [], rows[1:])]
    for found, empty in ((cuts, None), (slices, "")):
        parts = list(found(iter(batches), "t", 16))
        assert [t for p in parts for t in p.column("t").to_pylist()] == [empty if t is None else t for t in rows + rows[1:]]
        assert [i for p in parts for i in p.column("i").to_pylist()] == [*range(6), *range(5)] and all(len(p) == 1 or p.column("t").nbytes < 64 for p in parts)


def test_short_parts_are_found_without_the_dict():
    import random

    rng, made = random.Random(20), []
    known = Known(most=300, short=Short(bits=6))
    plain = Known(most=300)
    letters = ["a", "b", "\0", "é", " ", "zz"]

    def make(first, new):
        del made[first:]
        made.extend(new)

    for _ in range(40):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 90]))).encode() for _ in range(60)]
        found = pa.array([b"", b"left out", *texts], pa.binary())[2:]
        rows = known.rows(found, make)
        assert [made[r] for r in rows] == texts
        keys = known.short.keys_of(found)
        assert [k == 0 for k in keys] == [len(t) > 7 for t in texts]
        assert len({k for k, t in zip(keys, texts) if len(t) <= 7}) == len({t for t in texts if len(t) <= 7})
    assert set(known.short.find(known.short.keys_of(found)).tolist()) != {-1}
    # Another memory that is used empties this one.
    plain.rows(found, lambda first, new: None)
    assert not known and (known.short.find(keys) < 0).all()
