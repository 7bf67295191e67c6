"""The pipeline on a small corpus, each stage against a plain version of what it keeps."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.test_near_dedup import brute  # noqa: E402
from triagelake.llm import bpe, mixing  # noqa: E402


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    syllables = {"en": "the th er on ing and tion".split(), "de": "der ein ung sch ich keit und".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    rows, base = [], [word("en") for _ in range(80)]
    for i in range(240):
        lang = rng.choice(["en", "de"])
        text = " ".join(word(lang) for _ in range(rng.randint(5, 60)))
        if i % 8 == 0:
            near = list(base)
            near[rng.randrange(80)] = word("en")
            text, lang = " ".join(near), "en"
        rows.append((i, text, lang, rng.choice(["hot", "hot", "b", None]), len(text)))
    rows += [(300, rows[1][1], "en", "b", 0), (301, rows[1][1], "en", "b", 0), (302, "123 !!", "en", "b", 0), (303, None, None, "b", None), (304, "", "en", None, 0)]
    return rows


def test_stages(spark, docs_schema, corpus, tmp_path):
    rows = {r[0]: r for r in corpus}
    spark.createDataFrame(corpus, docs_schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != "encoded":
            assert found.columns == docs.columns
        found.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert sorted(kept["language"]) == sorted(i for i in rows if i < 302)
    last = {rows[i][1]: i for i in sorted(kept["language"])}
    assert sorted(kept["exact"]) == sorted(last.values())
    components = brute([(i, rows[i][1]) for i in kept["exact"]])
    assert sorted(kept["near"]) == sorted(set(components.values()))
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "near"))).collect()
    assert Counter(kept["mixed"]) == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    import public_tokenizers as tokenizers

    encoder = bpe.load(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    for r in docs.collect():
        assert r["ids"] == encoder.encode(rows[r["doc_id"]][1]) and r["n_tokens"] == len(r["ids"])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in run) == sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect())


def test_an_empty_corpus(spark, docs_schema, tmp_path):
    spark.createDataFrame([], docs_schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
