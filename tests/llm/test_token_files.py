import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from triagelake.llm import range_coder, token_files  # noqa: E402


def test_coder_round_trip():
    rng = np.random.default_rng(8)
    for k in range(40):
        n = int(rng.integers(1, 400))
        blocks = [rng.integers(0, [3, 65536, 300, 1][k % 4], n) for _ in range(int(rng.integers(0, 5)))] + [rng.integers(0, 50, int(rng.integers(1, n + 1)))]
        assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks)), strict=True))


def test_predictable_ids_are_short_and_damage_is_found():
    block = np.tile(np.arange(40), 100)
    coded = range_coder.encode([block])[0]
    assert len(coded) < len(block) // 8
    damaged = bytearray(coded)
    damaged[20] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode([bytes(damaged)])
    with pytest.raises(ValueError):
        range_coder.encode([np.array([1 << 16])])


def test_files(spark):
    rng = random.Random(9)
    words = ["the", " a", "é", "!", "\n", "zebra", "0"]
    rows = [(i, rng.choice([None, "", "! ! !", "".join(rng.choice(words) for _ in range(rng.choice([3, 200, 9000])))])) for i in rng.sample(range(1000), 120)]
    file = public.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = sorted(token_files.round_trip(docs, tokenizer_file=file).collect())
    encode, start = tokenizers.Tokenizer.from_file(file), 0
    for (i, text), r in zip(sorted(rows, key=lambda r: r[0]), found, strict=True):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_edges(spark):
    file = public.path("byte_bpe_50k.json")
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file=file).collect() == []
    rows = spark.createDataFrame([(None, "b"), (1, "z"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in sorted(token_files.round_trip(rows, tokenizer_file=file).collect(), key=lambda r: r["start"])] == [(None, 0), (1, 2), (1, 4), (1, 6)]


def test_cost_by_a_model_of_each_order():
    rng = np.random.default_rng(10)
    n = range_coder.BLOCK
    skewed = np.minimum(rng.geometric(0.05, n), 60_000)
    entropy = -sum(p * np.log2(p) for p in np.bincount(skewed)[1:] / n if p)
    assert 8 * len(range_coder.encode([skewed])[0]) / n < entropy + 1.0
    follows = np.cumsum(rng.integers(0, 2, n) * 7 + 1) % 500  # two followers of each id: order 1 alone helps
    alone = -sum(p * np.log2(p) for p in np.bincount(follows) / n if p)
    assert 8 * len(range_coder.encode([follows])[0]) / n < alone - 2
    assert 8 * len(range_coder.encode([rng.integers(0, 65536, n)])[0]) / n < 18.5


def test_blocks_are_independent():
    rng = np.random.default_rng(11)
    blocks = [rng.integers(0, 300, 900) for _ in range(9)]
    coded = range_coder.encode(blocks)
    assert coded == [range_coder.encode([b])[0] for b in blocks]
    assert all((range_coder.decode([c])[0] == b).all() for b, c in zip(blocks, coded, strict=True))


def test_files_roll_and_groups_keep_their_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 50)
    monkeypatch.setattr(token_files, "GROUPS_A_FILE", 3)
    records = [token_files.group_record(1, k, [k, None], [2, 3], np.arange(5) + k) + token_files.MARK for k in range(4)]
    found = list(token_files.groups_of(b"".join(records)))
    assert [(p, n, d, s.tolist(), i.tolist()) for p, n, d, s, i in found] == [(1, k, [k, None], [2, 3], [*range(k, k + 5)]) for k in range(4)]
    with pytest.raises(ValueError):
        list(token_files.groups_of(records[0][:-1]))
    docs = spark.createDataFrame([(i, "a word and more " * (i % 7)) for i in range(200)], "doc_id long, text string")
    token_files.write(docs, str(tmp_path / "t"), tokenizer_file=public.path("byte_bpe_50k.json"))
    found = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == list(range(200)) and [r["start"] for r in found] == list(np.cumsum([0] + [len(r["ids"]) for r in found[:-1]]))


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_what_whole_texts_give(file):
    own, library, rng = token_files.Tokens(public.path(file)), tokenizers.Tokenizer.from_file(public.path(file)), random.Random(12)
    library.encode_special_tokens = True
    bits = ["a", "the", " ", "  ", "\n", "\n\n", "é", "日本", "!!", "12", "'ll", "'s", " ", "　", " ", "😀", "\t", "zz", "-", ". ", "<|endoftext|>", "\x1c", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    import pyarrow as pa

    ids, starts = own.encode_all(pa.array(texts))
    for text, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_text_null_and_other_columns(spark):
    rows = [(3, "word " * 60_000, 1, 2, 3), (1, None, 1, 2, 3), (2, "", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, record long, part int")
    found = sorted(token_files.round_trip(docs, tokenizer_file=public.path("byte_bpe_50k.json")).collect())
    assert [r["n_tokens"] for r in found][:2] == [1, 1] and found[2]["start"] == 2 and found[2]["n_tokens"] > 60_000


def test_new_ids_are_a_stream_of_their_own():
    rng = np.random.default_rng(14)
    blocks = [rng.integers(0, 900, n) for n in (3000, 3000, 40, 1)]
    other = rng.permutation(65_536)
    for block, a, b in zip(blocks, range_coder.encode(blocks), range_coder.encode([other[b] for b in blocks]), strict=True):
        _, of_slots, of_new, _ = range_coder._HEAD.unpack_from(a)
        slots = slice(range_coder._HEAD.size, range_coder._HEAD.size + 2 * of_slots)
        assert a[slots] == b[slots] and len(a) == range_coder.record_size(a) == slots.stop + 2 * of_new
        assert (range_coder.decode([b])[0] == other[block]).all()


def test_damage_anywhere_is_found():
    block = np.random.default_rng(15).geometric(0.02, 500)
    coded = range_coder.encode([block])[0]
    for at in [*range(range_coder._HEAD.size), *range(range_coder._HEAD.size, len(coded) - 250, 23)]:
        damaged = bytearray(coded)
        damaged[at] ^= 255
        with pytest.raises(ValueError):
            range_coder.decode([bytes(damaged)])


def test_words_of_latin_letters_beside_others():
    import pyarrow as pa

    file, letters = public.path("byte_bpe_50k.json"), [*"aZ\u00e9\u00df\u00aa\u00ba\u0131\u01c5\u024f\u0250\u03b1\u0436\u4e2d\u0301\u00b2\u00d7", "\u00a0", "\u00ad"]
    rng, library = random.Random(16), tokenizers.Tokenizer.from_file(file)
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    ids, starts = token_files.Tokens(file).encode_all(pa.array(texts))
    assert all(ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, starts, starts[1:]))


def test_new_ids_take_the_bits_of_their_class():
    ids = np.random.default_rng(17).permutation(65_536)
    blocks = [ids[i : i + 4096] for i in range(0, 65_536, 4096)] + [ids[:1]]
    streams, sizes = range_coder._encode_new(blocks), np.array(list(map(len, blocks)))
    found = range_coder._decode_new([np.frombuffer(s, np.uint8) for s in streams], sizes)
    assert all((row[: len(b)] == b).all() for row, b in zip(found, blocks, strict=True))
    for stream, block in zip(streams, blocks, strict=True):
        bits = int(range_coder._CLASS_BITS[range_coder._CLASS[block]].sum())
        assert len(stream) == (len(block) + (bits + 7) // 8 + 1) // 2 * 2
    with pytest.raises(ValueError):
        range_coder._decode_new([np.frombuffer(streams[0], np.uint8)[:-2]], sizes[:1])


def test_a_step_takes_an_id_of_each_strand(monkeypatch):
    steps, predict = [], range_coder._Model.predict
    monkeypatch.setattr(range_coder._Model, "predict", lambda self, span: (steps.append(len(span)), predict(self, span))[1])
    block = np.random.default_rng(18).geometric(0.01, range_coder.BLOCK)
    (coded,) = range_coder.encode([block])
    assert (range_coder.decode([coded])[0] == block).all()
    assert len(steps) <= range_coder.BLOCK // 2


def test_strands_of_any_length():
    rng = np.random.default_rng(19)
    for n in [*range(1, 40), 511, 513, 4095]:
        # Ids that are new in several strands of one step, and in others after it.
        for block in (np.full(n, 7), np.arange(n), np.arange(n) % 5, np.repeat(rng.integers(0, 65_536, n), 3)[:n], rng.integers(0, 9, n)):
            assert (range_coder.decode(range_coder.encode([block]))[0] == block).all()
            ordered = range_coder._by_steps(block)
            assert (range_coder._by_strands(ordered) == block).all()
    blocks = [rng.integers(0, 300, n) for n in (4096, 4096, 4090, 777, 777, 770, 20, 9, 8, 7, 1, 1)]
    coded = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert coded == [range_coder.encode([b])[0] for b in blocks]


def test_order_and_parts_over_several_batches_of_blocks(monkeypatch):
    blocks = [np.random.default_rng(n).integers(0, 99, 200 - n) for n in range(11)]
    whole = range_coder.encode(blocks)
    monkeypatch.setattr(range_coder, "AT_ONCE", 3)
    assert range_coder.encode(blocks) == whole
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(whole), strict=True))
