import os
import zlib

import pytest
from pyspark.sql import functions as F

from triagelake.llm import language_id as lid


def test_backs_off_to_ngrams_for_unseen_words():
    model = lid.build([("de", "einheit", 9), ("de", "freiheit", 7), ("en", "nation", 9), ("en", "station", 8)])
    assert model.predict("Schönheit")[0] == "de" and model.predict("relation")[0] == "en"
    assert model.predict("einheit")[1] > 0.5
    assert lid.build([]).predict("word") == ("und", 0.0)


@pytest.mark.parametrize("text", [None, "", "123 !! 45", "½ ² _"])
def test_undetermined(text):
    assert lid.build([("en", "word", 2)]).predict(text) == ("und", 0.0)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    docs = spark.read.parquet(folder)
    model = lid.fit(docs.filter(~lid.held_out(docs["doc_id"])))
    found = lid.annotate(docs, model).withColumn("held", lid.held_out(F.col("doc_id"))).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in found)


def test_edges(spark):
    rows = spark.createDataFrame([(1, "the word", None), (2, None, "en"), (3, "the the", "en"), (None, "the", "en")], "doc_id long, text string, lang string")
    model = lid.fit(rows)
    assert [r["lang_pred"] for r in lid.annotate(rows, model).collect()] == ["en", "und", "en", "en"]
    assert lid.annotate(rows.filter("false"), lid.fit(rows.filter("false"))).collect() == []


def brute(rows, text):
    """The same law, word by word and n-gram by n-gram, from counts alone."""
    import math

    languages = sorted({r[0] for r in rows})

    def table(keys, least=0):
        counts = {}
        for lang, key, n in keys:
            counts.setdefault(key, dict.fromkeys(languages, 0))[lang] += n
        counts = {k: c for k, c in counts.items() if sum(c.values()) >= least}
        totals = {x: sum(c[x] for c in counts.values()) for x in languages}
        return {k: {x: math.log((c[x] + 0.5) / (totals[x] + 0.5 * len(counts) + 1)) for x in languages} for k, c in counts.items()}

    words = table(rows, 2)
    grams = {n: table((r[0], g, r[2]) for r in rows for g in lid.grams_of(r[1], n)) for n in (5, 4, 3, 2, 1)}
    total = dict.fromkeys(languages, 0.0)
    found = [w.lower() for w in lid.WORDS.findall(text) if any(map(str.isalpha, w))]
    for w in found:
        if w in words:
            score = words[w]
        else:
            padded, covered, parts, cost = f"^{w}$", {0, len(w) + 1}, [], 0.0
            for n in (5, 4, 3, 2, 1):
                here = [i for i in range(len(padded) - n + 1) if not set(range(i, i + n)) <= covered and padded[i : i + n] in grams[n]]
                parts += [{x: grams[n][padded[i : i + n]][x] + cost for x in languages} for i in here]
                covered |= {k for i in here for k in range(i, i + n)}
                cost -= 0.7
                if len(covered) == len(padded):
                    break
            left = len(padded) - len(covered)
            score = {x: (sum(p[x] for p in parts) - 12.0 * left) / max(1, (len(parts) + left) ** 0.5) for x in languages}
        total = {x: total[x] + score[x] for x in languages}
    if not found:
        return "und", 0.0
    top = max(total.values())
    likely = {x: math.exp(v - top) for x, v in total.items()}
    best = min(languages, key=lambda x: (-likely[x], x))
    return best, likely[best] / sum(likely.values())


def test_equal_to_brute_force():
    import random

    rng = random.Random(3)
    words = ["the", "nation", "station", "über", "einheit", "freiheit", "école", "été", "l", "d", "qu", "straße", "x"]
    rows = sorted({(rng.choice(["de", "en", "fr"]), w): rng.randint(1, 4) for w in words for _ in range(3)}.items())
    rows = [(lang, w, n) for (lang, w), n in rows]
    model = lid.build(rows)
    bits = [*words, "The", "ÜBER", "relation", "einhe", "zzz", "日本", "İx", "ΑΣ", "½", "12", "_", ".", "'", " ", ",", " ", "\n", "-"]
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12)))
        lang, score = model.predict(text)
        expected = brute(rows, text)
        assert abs(score - expected[1]) < 1e-5 and (lang == expected[0] or abs(expected[1] - 0.5) < 1e-5)


def test_draw_is_exact_for_languages_of_any_size(spark):
    n = 3000
    rows = spark.range(n).selectExpr("id", "if(id % 10 = 0, 'fr', 'en') AS lang", "'t' AS text")
    found = {r["lang"]: r["n"] for r in lid.drawn(rows, 500).groupBy("lang").count().withColumnRenamed("count", "n").collect()}
    assert found["fr"] == 300 and 400 < found["en"] < 600
    # A language of thousands of millions of documents keeps its share.
    for n in (10**9 + 1, 4 * 10**9, 10**15):
        assert abs(lid.hash_bound(1000, n) / 2**63 * n - 1000) < 1e-3
    assert lid.hash_bound(1000, 1000) == lid.hash_bound(1000, 3) == 2**63 - 1


def test_equal_rows_and_rows_without_ids_are_drawn_one_by_one(spark):
    for n, row in ((20_000, "CAST(NULL AS LONG) AS id, 'eo' AS lang, 'saluton' AS text"), (5_000, "7L AS id, 'eo' AS lang, concat('saluton ', id) AS text"), (5_000, "7L AS id, 'eo' AS lang, 'saluton' AS text"), (600, "CAST(NULL AS LONG) AS id, 'eo' AS lang, 'saluton' AS text")):
        rows = spark.range(n).selectExpr(*row.split(", ", 2))
        kept = lid.drawn(rows, 1000).count()
        assert kept == n if n <= 1000 else 800 < kept < 1200
        assert lid.fit(rows.unionByName(spark.createDataFrame([(1, "en", "the station")], rows.schema)), id_col="id").languages == ["en", "eo"]


def test_long_text_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "the station " * 40_000, "en", "x", "y", 1.0), (2, "einheit", "de", "x", "y", 1.0)], "doc_id long, text string, lang string, lang_pred string, __text string, score double")
    found = lid.annotate(rows, lid.fit(rows))
    assert sorted(found.columns) == ["__text", "doc_id", "lang", "lang_pred", "score", "text"]
    assert [r["lang_pred"] for r in found.orderBy("doc_id").collect()] == ["en", "de"]
