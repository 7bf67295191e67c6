import base64
import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

from triagelake.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def both():
    file = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    return bpe.load(file, tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(both):
    own, library = both
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n\n", "é", "日本", "!!", "12", "'ll", "er", "́", "😀", "\t", "zz", "-", "<|endoftext|>", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    long = "ab" * 20_000 + "é" * 5000
    assert own.encode(long) == library.encode_ordinary(long)


def test_appends_and_edits(both):
    vocabulary, rng = both[0].vocabulary, random.Random(5)
    draw = lambda n: bytes(rng.choice(b"abcdefthiser ") for _ in range(n))
    for _ in range(300):
        data = draw(rng.randint(0, 80))
        table = bpe.Prefixes(vocabulary, data)
        start = rng.randint(0, len(data))
        stop, new = rng.randint(start, len(data)), draw(rng.randint(0, 6))
        table.replace(start, stop, new)
        table.append(b"thes")
        assert table.last == bpe.Prefixes(vocabulary, data[:start] + new + data[stop:] + b"thes").last
    table = bpe.Prefixes(vocabulary, draw(20_000))
    assert table.replace(100, 101, b"q") < 2000


def test_documents(spark, both):
    rows = [(1, "Hello there, world"), (2, None), (3, ""), (3, "x" * 3000), (None, "é")]
    kw = {"ranks_file": tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": tokenizers.PATTERN}
    found = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t in rows:
        ids = both[1].encode_ordinary(t or "")
        expected.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string, ids int"), **kw).collect() == []
